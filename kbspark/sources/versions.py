"""Tables whose partitions are replaced together, so that a change writes only the partitions it touches.

A row lies in the partition of its space and of its document's block, a range of ``block_documents`` document ids. Every
write puts its rows into new folders beside the old ones. A version is a small table that names the folder of every
partition of every table; it is written aside and then renamed to its number, which fails if that number exists. So
readers see all tables before a change or all after it, a failed write is never seen, and of two writers that start
from the same version one has to start again. Reading prunes spaces and blocks before any file is opened.
"""

import uuid
from collections.abc import Container, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kbspark.schemas import SORT_KEYS, TABLES
from kbspark.sources.folders import shuffles_dropped

# Rewritten documents remember the first chunk id that they never had.
SCHEMAS = {
    "kb_document": StructType([*TABLES["kb_document"].fields, StructField("next_chunk_id", LongType())]),
    "kb_chunk": TABLES["kb_chunk"],
    "chunk_vector": TABLES["chunk_vector"],
    "chunk_gram": StructType().add("space_id", "long").add("document_id", "long").add("gram", "string").add("chunks", "long")
    .add("lowest", "long").add("chunk_ids", "binary"),
}

_SORTED = {**SORT_KEYS, "chunk_gram": ["gram"]}

# Texts take two thirds of the room that they take with the usual codec.
_CODEC = "zstd"

BLOCK_DOCUMENTS = 10_000

# Blocks of a new table are doubled until it has about so many partitions at most, or hardly fewer than before.
MAX_PARTS = 256
_DOUBLINGS = 24

# The entry of a version that tells the size of blocks.
_BLOCK = ""

_ENTRY = "name string, space_id long, block long, folder string"


class Part(NamedTuple):
    space_id: int | None
    block: int | None


class CommitConflict(RuntimeError):
    """Another writer has made the next version."""


class Versions:
    """The versions of the tables under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, block_documents: int = BLOCK_DOCUMENTS):
        """``block_documents`` is the least size of a block; the first version decides and is asked from then on."""
        self.spark, self.root, self._least, self._block = spark, root.rstrip("/"), block_documents, None

    @property
    def block_documents(self) -> int:
        if self._block is None and (version := self.current()):
            self.parts(version)
        return self._block or self._least

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _found(self, pattern: str) -> list[str]:
        """Names below the root that match."""
        found = self._files().globStatus(self._path(pattern)) or []
        start = self._files().makeQualified(self._path("")).toString().rstrip("/") + "/"
        return [one.getPath().toString().removeprefix(start) for one in found]

    # --- reading ---

    def current(self) -> int:
        """The number of the newest version, 0 before the first."""
        return max((int(name.rsplit("/", 1)[-1]) for name in self._found("versions/[0-9]*")), default=0)

    def parts(self, version: int) -> dict[str, dict[Part, str]]:
        """Folders by table and partition."""
        out: dict[str, dict[Part, str]] = {}
        if version:
            for row in self.spark.read.schema(_ENTRY).parquet(f"{self.root}/versions/{version:012d}").collect():
                if row["name"] == _BLOCK:
                    self._block = row["block"]
                    continue
                out.setdefault(row["name"], {})[Part(row["space_id"], row["block"])] = row["folder"]
        return out

    def block(self, document_id: Column) -> Column:
        return F.floor(document_id / self.block_documents)

    def read(self, name: str, version: int | None = None, only: Iterable[Part] | None = None) -> DataFrame:
        """A table in a version (the newest), or of it the partitions in ``only``; with the column ``block``."""
        known = self.parts(self.current() if version is None else version).get(name, {})
        folders = [known[part] for part in (known if only is None else set(only)) if part in known]
        schema = StructType([*SCHEMAS[name].fields, StructField("block", LongType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}"
        return (self.spark.read.schema(schema.add("write", "string")).option("basePath", base)
                .parquet(*[f"{self.root}/{folder}" for folder in folders]).drop("write"))

    # --- writing ---

    def commit(self, base: int, tables: dict[str, DataFrame], touched: Iterable[Part] | None = None,
               placed: Container[str] = ()) -> int:
        """The number of a new version in which ``tables`` replace the ``touched`` partitions of version ``base``.

        The rows of ``tables`` belong to touched partitions; without ``touched`` they replace the whole tables. Other
        partitions and tables keep their files. Tables named in ``placed`` were made row by row of a table of this store:
        their rows lie together with those of their partition already, and every task writes its own without a shuffle.
        Raises ``CommitConflict`` when there is a newer version than ``base``.
        """
        write, parts = uuid.uuid4().hex, self.parts(base)
        if not base:
            self._block = self._fitting(*next(iter(tables.items()))) if tables else None
        for name, rows in tables.items():
            schema, document = SCHEMAS[name], "id" if name == "kb_document" else "document_id"
            columns = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
            dealt = rows.select(*columns).withColumns({"block": self.block(F.col(document)).cast("long"), "write": F.lit(write)})
            keys = ["space_id", "block"]
            if name not in placed:
                # Rows of a partition go together; at run time small ones share a task and large ones are split.
                dealt = dealt.hint("rebalance", *keys)
            with shuffles_dropped(self.spark):
                (dealt.sortWithinPartitions(*keys, *_SORTED.get(name, ["id"])).write.option("compression", _CODEC)
                 .partitionBy(*keys, "write").mode("append").parquet(f"{self.root}/{name}"))
            kept = parts.get(name, {})
            kept = {} if touched is None else {part: folder for part, folder in kept.items() if part not in set(touched)}
            new = {_part_of(folder): folder for folder in self._found(f"{name}/space_id=*/block=*/write={write}")}
            if touched is not None and not set(new) <= set(touched):
                raise ValueError(f"{name}: rows outside the touched partitions")
            parts[name] = {**kept, **new}
        entries = [(name, *part, folder) for name, known in parts.items() for part, folder in known.items()]
        entries.append((_BLOCK, None, self.block_documents, _BLOCK))
        aside = f"versions/.{write}"
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.parquet(f"{self.root}/{aside}")
        return self._publish(aside, base + 1)

    def _fitting(self, name: str, rows: DataFrame) -> int:
        """The size of blocks: a partition costs a folder and a file, so their number must not grow with the table."""
        document = F.col("id" if name == "kb_document" else "document_id")
        sizes = [self._least << n for n in range(_DOUBLINGS)]
        counts = rows.agg(*[F.approx_count_distinct(F.xxhash64("space_id", F.floor(document / size))) for size in sizes]).first()
        return next(size for size, count in zip(sizes, counts, strict=True) if count <= max(MAX_PARTS, counts[-1] * 1.1))

    def _publish(self, aside: str, number: int) -> int:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        target = self._path(f"versions/{number:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        never_over = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            if self.current() < number:
                context.rename(self._path(aside), target, never_over)
                return number
        except Exception:
            if self.current() < number:
                raise
        self._files().delete(self._path(aside), True)
        self._block = None
        raise CommitConflict(f"version {number} exists")

    def clean(self, keep: int = 1) -> int:
        """Removes versions before the newest ``keep``, and folders that none of these names; tells how many folders.

        Only when nobody writes, and nobody reads older versions.
        """
        newest, files = self.current(), self._files()
        named = {folder for n in range(max(1, newest - keep + 1), newest + 1) for known in self.parts(n).values() for folder in known.values()}
        gone = [folder for folder in self._found("*/space_id=*/block=*/write=*") if folder not in named]
        for folder in [*gone, *self._found("versions/.*"), *[f"versions/{n:012d}" for n in range(1, newest - keep + 1)]]:
            files.delete(self._path(folder), True)
        return len(gone)


def _part_of(folder: str) -> Part:
    values = dict(piece.split("=", 1) for piece in folder.split("/") if "=" in piece)
    return Part(*[None if values[name].startswith("__HIVE_DEFAULT") else int(values[name]) for name in ("space_id", "block")])
