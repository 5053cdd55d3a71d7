"""Token totals by source, language and tokenizer version, kept up to date by signed changes.

A batch of changes is counted per document, turned into signed rows (a new document adds, a deleted one subtracts, a
revised one does both), summed to a few rows per batch and written to a folder of its own. The batch is committed by
the rename of a small marker to the batch's name, which fails if the name is taken: a batch that is sent again, or by
two writers at once, counts once, and one that was cut off before does not count.

Totals are kept: after some batches their changes are added to the base, the totals of all batches before them. A base
also appears by a rename, and names the batches it took in, whose markers move from ``open`` to ``closed`` afterwards.
Whoever reads meets one base and a few batches, whatever the number of batches ever committed.
"""

import base64
import uuid
from collections.abc import Iterator
from pathlib import PurePath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.llm.common import stored

GROUP = ["source", "lang", "tokenizer"]
CHANGES = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# How the rank files' tokenizers split texts before merging: a fixed value of these vocabularies.
SPLIT = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

# Texts are encoded in pieces that end before a space, where the split pattern starts a new piece anyway.
PIECE = 1 << 16

_LOADED = {}


def _encoder(path: str):
    """The tokenizer of a rank file, loaded once per Python worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path] = tiktoken.Encoding(PurePath(path).name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(text: str, path: str) -> int:
    encoder, total, start = _encoder(path), 0, 0
    while len(text) - start > PIECE:
        # A single space before a letter starts a piece whatever stands before it, unless that is a gap too.
        end = text.find(" ", start + PIECE)
        while end > 0 and (text[end - 1].isspace() or not text[end + 1:end + 2].isalpha()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        total += len(encoder.encode_ordinary(text[start:end]))
        start = end
    return total + len(encoder.encode_ordinary(text[start:]))


def per_document(docs: DataFrame, tokenizers: dict[str, str], key: str = "doc_id", text: str = "text",
                 source: str = "source", lang: str = "lang") -> DataFrame:
    """``(doc_id, source, lang, tokenizer, n_tokens)``: a row per document and tokenizer version.

    ``tokenizers`` maps version names to rank files, which every worker must be able to read. Null and empty texts
    have no tokens. Null sources and languages are groups of their own. Other columns are not read.
    """
    names, paths = list(tokenizers), list(tokenizers.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value or "" for value in batch.column(3).to_pylist()]
            for name, path in zip(names, paths, strict=True):
                yield pa.record_batch([*batch.columns[:3], pa.array([name] * len(texts), pa.string()),
                                       pa.array([count_tokens(value, path) for value in texts], pa.int64())],
                                      names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(lang).alias("lang"),
                       F.col(text).alias("text"))
    schema = rows.select("doc_id", "source", "lang").schema.add("tokenizer", "string").add("n_tokens", "long")
    return rows.mapInArrow(count, schema)


def changes(gone: DataFrame | None, come: DataFrame | None) -> DataFrame:
    """Signed group sums of counted documents that are ``gone`` and that have ``come``; a revision is in both.

    Sums are formed in every task first, so a hot source is a few rows per task.
    """
    parts = [rows.select(*GROUP, F.lit(sign).alias("sign"), "n_tokens") for rows, sign in ((gone, -1), (come, 1))
             if rows is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"),
                                    F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))


class Rollup:
    """Totals in a shared folder: ``changes``, the markers ``open`` and ``closed``, and ``base``."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 20):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    # --- files ---

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("open").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        found = self._files().globStatus(self._path(f"{folder}/*")) or []
        return sorted(name for one in found if not (name := one.getPath().getName()).startswith((".", "_")))

    def _moved(self, source: str, target: str) -> bool:
        """Renames unless the target exists, in one step; False if it does."""
        hadoop, there = self.spark._jvm.org.apache.hadoop.fs, self._path(target)
        self._files().mkdirs(there.getParent())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(there.toUri(), self.spark._jsc.hadoopConfiguration()).rename(
                self._path(source), there, never_over)
        except Exception:
            if not self._files().exists(there):
                raise
            self._files().delete(self._path(source), True)
            return False
        return True

    # --- batches ---

    def committed(self) -> list[str]:
        """Names of the batches that count, for reports; neither commits nor totals list them all."""
        return sorted({*self._names("open"), *self._names("closed")})

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Write the changes of ``batch`` and commit it; False, without any change, if it was committed before."""
        if not batch or not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch name: {batch!r}")
        if any(self._files().exists(self._path(f"{state}/{batch}")) for state in ("closed", "open")):
            return False
        write = uuid.uuid4().hex
        folder = f"changes/{batch}/{write}"
        rows.select(*GROUP, "n_docs", "n_tokens").write.parquet(f"{self.root}/{folder}")
        self.spark.createDataFrame([(batch, folder)], "name string, folder string").coalesce(1).write.parquet(
            f"{self.root}/open/.{write}")
        if not self._moved(f"open/.{write}", f"open/{batch}"):
            return False
        if len(self._names("open")) >= self.compact_every:
            self.compact()
        return True

    def _state(self) -> tuple[int, set[str], dict[str, str]]:
        """Number of the newest base, the batches it names, and the folders of the open batches beyond it."""
        # Markers are listed before the base is chosen: a batch that is merged in between is then named by the base.
        names = self._names("open")
        base = max((int(name) for name in self._names("base")), default=0)
        merged = set()
        if base:
            merged = {row["name"] for row in self.spark.read.schema("name string").parquet(f"{self.root}/base/{base:012d}/merged").collect()}
        left = [name for name in names if name not in merged]
        folders = {}
        for name in left:
            # A marker that came back after its batch was closed says nothing new.
            if not self._files().exists(self._path(f"closed/{name}")):
                folders[name] = self.spark.read.schema("folder string").parquet(f"{self.root}/open/{name}").first()["folder"]
        return base, merged & set(names), folders

    def _sums(self, base: int, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.root}/{folder}" for folder in folders.values()]
        paths += [f"{self.root}/base/{base:012d}/totals"] if base else []
        rows = self.spark.read.schema(CHANGES).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES)
        return rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
            "n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Adds the open batches to the base; of several writers that do so at once, one does."""
        base, still_open, folders = self._state()
        if folders:
            aside = f"base/.{uuid.uuid4().hex}"
            self._sums(base, folders).write.parquet(f"{self.root}/{aside}/totals")
            names = [(name,) for name in sorted({*still_open, *folders})]
            self.spark.createDataFrame(names, "name string").coalesce(1).write.parquet(f"{self.root}/{aside}/merged")
            if not self._moved(aside, f"base/{base + 1:012d}"):
                return
        for name in {*still_open, *folders}:
            self._moved(f"open/{name}", f"closed/{name}")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``; groups without documents are left out."""
        base, _, folders = self._state()
        return self._sums(base, folders)


def counts_of(counted: DataFrame, names: DataFrame) -> DataFrame:
    """The stored counts of the documents that ``names`` lists in its column ``doc_id``; a null id names none.

    A document that is listed several times counts once.
    """
    return counted.join(stored(names.select("doc_id").distinct(), "changed"), "doc_id", "left_semi")
