"""Spaces and documents as batch change feeds, and the cutting of documents into chunks."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import text as tx
from kbspark.operators.limits import broadcast_if, pin

# First chunk ids are ``document id * CHUNK_ID_FACTOR + chunk index``, so they need no counter.
CHUNK_ID_FACTOR = 1_000_000

# Bytes of a broadcast row about one document.
_MARK_BYTES = 160


_DOCUMENT_COLUMNS = ["id", "space_id", "title", "content", "source_type", "source_uri", "status"]


class Changed(NamedTuple):
    documents: DataFrame
    chunks: DataFrame
    rejects: DataFrame


# --- chunks ---------------------------------------------------------------------------------------------------

def with_chunks(documents: DataFrame, content: str = "content", max_size: int = fv.CHUNK_MAX_SIZE,
                overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Add ``chunks``, the array of overlapping pieces of the normalised text.

    A piece is one block of ``size - overlap`` characters followed by the head of the next block. Cutting blocks
    with one regular expression passes over the text once; a ``substring`` per piece would walk UTF-8 text from
    its start every time.
    """
    size = max(fv.CHUNK_MIN_SIZE, max_size)
    lap = max(0, min(overlap, size // 2))
    blocks = F.regexp_extract_all(
        tx.trimmed(tx.unix_newlines(F.col(content))), F.lit(f"(?s).{{1,{size - lap}}}"), F.lit(0))
    cut = documents.withColumn("_blocks", F.coalesce(blocks, F.array().cast("array<string>")))
    block_count = F.size("_blocks")
    # A last block no longer than the overlap already is the tail of the piece before it.
    piece_count = F.when(
        (block_count > 1) & (F.length(F.try_element_at("_blocks", F.lit(-1))) <= lap), block_count - 1
    ).otherwise(block_count)
    following = F.slice("_blocks", F.lit(2), F.greatest(block_count, F.lit(1)))
    pieces = F.zip_with(
        "_blocks", following,
        lambda block, after: F.concat(block, F.coalesce(F.substring(after, 1, lap), F.lit(""))))
    kept = F.filter(
        F.transform(F.slice(pieces, F.lit(1), piece_count), tx.trimmed), lambda piece: F.length(piece) > 0)
    return cut.withColumn("chunks", kept).drop("_blocks")


def chunk_documents(documents: DataFrame, max_size: int = fv.CHUNK_MAX_SIZE, overlap: int = fv.CHUNK_OVERLAP,
                    keep: Sequence[str] = ()) -> DataFrame:
    """One new pending chunk row per piece, with the document's columns ``keep``; a narrow stage without shuffles."""
    cut = with_chunks(documents.select("id", "space_id", "content", *keep), max_size=max_size, overlap=overlap)
    # The outer form: for the inner one Spark adds a filter on the array's size, and cuts every text twice.
    return cut.select(
        F.col("id").alias("document_id"), "space_id", F.posexplode_outer("chunks").alias("chunk_index", "content"), *keep,
    ).filter("chunk_index is not null").select(
        (F.col("document_id") * CHUNK_ID_FACTOR + F.col("chunk_index")).alias("id"),
        "document_id", "space_id", "chunk_index", "content",
        F.length("content").alias("char_count"),
        F.lit(fv.EMBEDDING_PENDING).alias("embedding_status"),
        F.lit(None).cast("string").alias("vector_id"),
        F.lit(fv.ACTIVE).alias("status"), *keep,
    )


def chunk_counts(documents: DataFrame, max_size: int = fv.CHUNK_MAX_SIZE,
                 overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Documents with their ``chunk_count`` (0 without text), counted before any explode."""
    return (with_chunks(documents, max_size=max_size, overlap=overlap)
            .withColumn("chunk_count", F.size("chunks")).drop("chunks"))


# --- field rules ----------------------------------------------------------------------------------------------

def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()]))


def _blank(name: str) -> Column:
    return F.coalesce(F.length(tx.trimmed(F.col(name))), F.lit(0)) == 0


def _too_long(limits: dict[str, int]) -> dict[str, Column]:
    return {f"{name} longer than {size}": F.length(name) > size for name, size in limits.items()}


def document_rules(space_required: bool = True) -> dict[str, Column]:
    rules = {"title blank": _blank("title"), "content blank": _blank("content"),
             **_too_long(fv.DOCUMENT_LIMITS)}
    return {"space_id missing": F.col("space_id").isNull(), **rules} if space_required else rules


def space_rules() -> dict[str, Column]:
    return {"name blank": _blank("name"), **_too_long(fv.SPACE_LIMITS)}


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "id") -> DataFrame:
    """One row per broken rule."""
    return rows.select(key, F.explode(_broken(rules)).alias("rule"))


def conforming(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.filter(F.size(_broken(rules)) == 0)


# --- spaces ---------------------------------------------------------------------------------------------------

def space_name_conflicts(spaces: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests ``(id, name)`` whose name another active space has, or an earlier request claimed.

    A request may carry the id of an existing space (an update); keeping one's own name is no conflict. Names are
    grouped with map-side combining, so a name that most requests share costs one row per task.
    """
    taken = (spaces.filter(F.col("status") == fv.ACTIVE).groupBy("name")
             .agg(F.min("id").alias("owner_min"), F.max("id").alias("owner_max")))
    first = requests.groupBy("name").agg(F.min("id").alias("first_request"))
    claims = first.join(taken, "name", "left")
    return (requests.select("id", "name").join(claims, "name")
            .filter((F.col("owner_min") != F.col("id")) | (F.col("owner_max") != F.col("id"))
                    | (F.col("first_request") != F.col("id")))
            .select("id", "name",
                    F.when((F.col("owner_min") != F.col("id")) | (F.col("owner_max") != F.col("id")),
                           "name of an active space")
                    .otherwise("name of an earlier request").alias("reason")))


def upsert_spaces(spaces: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spaces after create and update requests ``(id, name, description)``, and the rejected requests.

    Rejected are requests that break a field rule, name a deleted space, repeat an id, or want a name that is taken;
    only valid requests claim names. Other columns of ``spaces`` are kept.
    """
    dead = spaces.filter(F.col("status") != fv.ACTIVE).select("id", F.lit(True).alias("dead"))
    # Requests of one id are counted in every task first.
    repeated = requests.groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("repeated"))
    judged = requests.join(dead, "id", "left").join(repeated, "id", "left").withColumn(
        "reason", F.when(F.col("dead"), "space not found").when(F.col("repeated"), "repeated request")
        .otherwise(F.get(_broken(space_rules()), F.lit(0))))
    valid = judged.filter(F.col("reason").isNull()).select(*requests.columns)
    rejects = judged.filter(F.col("reason").isNotNull()).select("id", "name", "reason").unionByName(
        space_name_conflicts(spaces, valid))
    accepted = valid.join(rejects, "id", "left_anti").select(
        "id", F.col("name").alias("new_name"), F.col("description").alias("new_description"),
        F.lit(True).alias("asked"))
    asked = F.coalesce("asked", F.lit(False))
    after = spaces.join(accepted, "id", "full_outer").select(
        "id",
        F.when(asked, F.col("new_name")).otherwise(F.col("name")).alias("name"),
        F.when(asked, F.col("new_description")).otherwise(F.col("description")).alias("description"),
        F.coalesce("status", F.lit(fv.ACTIVE)).alias("status"),
        *[name for name in spaces.columns if name not in ("id", "name", "description", "status")])
    return after, rejects


def deletable_spaces(spaces: DataFrame, documents: DataFrame) -> DataFrame:
    """Active spaces without active documents."""
    used = documents.filter(F.col("status") == fv.ACTIVE).select(F.col("space_id").alias("id")).distinct()
    return spaces.filter(F.col("status") == fv.ACTIVE).join(used, "id", "left_anti")


def delete_spaces(spaces: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Spaces after soft-deleting those of ``ids`` that may be deleted."""
    gone = (deletable_spaces(spaces, documents).join(ids.select("id").distinct(), "id", "left_semi")
            .select("id", F.lit(True).alias("gone")))
    return spaces.join(gone, "id", "left").withColumn(
        "status", F.when(F.col("gone"), fv.DELETED).otherwise(F.col("status"))).drop("gone")


def space_delete_rejects(spaces: DataFrame, documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, reason)`` of the spaces in ``ids`` that cannot be deleted."""
    asked = ids.select("id").distinct()
    active = spaces.filter(F.col("status") == fv.ACTIVE).select("id", F.lit(True).alias("known"))
    free = deletable_spaces(spaces, documents).select("id", F.lit(True).alias("free"))
    reason = F.when(F.col("known").isNull(), "space not found").when(F.col("free").isNull(), "space has active documents")
    return asked.join(active, "id", "left").join(free, "id", "left").select("id", reason.alias("reason")).filter(
        F.col("reason").isNotNull())


# --- documents ------------------------------------------------------------------------------------------------

def prepare_documents(requests: DataFrame) -> DataFrame:
    """Create requests as active document rows."""
    return (requests
            .withColumn("source_type", tx.default_if_blank(F.col("source_type"), F.lit(fv.DEFAULT_SOURCE_TYPE)))
            .withColumn("status", F.lit(fv.ACTIVE)))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. The limit runs in every task before the shuffle, so hot keys stay small."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(name) for name in order])
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def apply_document_changes(documents: DataFrame, chunks: DataFrame, changes: DataFrame, spaces: DataFrame,
                           max_size: int = fv.CHUNK_MAX_SIZE, overlap: int = fv.CHUNK_OVERLAP,
                           judged: DataFrame | None = None) -> Changed:
    """Documents and chunks after a feed of ``(seq, op, id, space_id, title, content, source_type, source_uri)``.

    ``op`` is ``create``, ``update`` or ``delete``; ``seq`` orders the feed. The result is that of applying the
    changes one by one: a change needs an active document (or its create earlier in the feed) and, if it names a
    space, an active space; nothing follows a delete; space and source type are kept when an update omits them.
    Every touched document gets all its chunks anew, as pending. Changes of an unknown kind, without an id, or that
    break a field rule are rejected first and have no effect on others. ``judged`` is what ``judge_changes`` said of
    the feed, where ``documents`` and ``chunks`` are only the partitions that it touches.

    Documents keep their other columns; written ones get ``chunk_count`` and ``next_chunk_id``, the first id that no
    chunk of the document has ever had. Feed the result in again, and ids stay unused even after a rewrite to blank.
    """
    # Changes are judged without their texts; each document's last valid text is fetched once, by its number.
    judged = judge_changes(documents, changes, spaces) if judged is None else judged
    rejects = judged.filter(F.col("reason").isNotNull()).select("seq", "op", "id", "reason")
    is_write = F.col("op") != "delete"
    decided = pin(judged.filter(F.col("reason").isNull()).groupBy("id").agg(
        F.max(F.when(is_write, F.col("seq"))).alias("seq"),
        F.max_by("space_id", F.when(is_write & F.col("space_id").isNotNull(), F.col("seq"))).alias("new_space"),
        F.max_by("source_type", F.when(is_write & ~_blank("source_type"), F.col("seq"))).alias("new_source_type"),
        F.any_value("old_space").alias("old_space"), F.any_value("old_source_type").alias("old_source_type"),
        F.any_value("others").alias("others"),
        F.coalesce(F.bool_or(~is_write), F.lit(False)).alias("deleted")), "decided-changes")
    marks = decided.select("id", F.col("seq").isNotNull().alias("written"), "deleted")
    # A small feed is broadcast, and documents and chunks are rewritten without a shuffle of their texts.
    touched = decided.count()

    def marked(rows: DataFrame, key: str) -> DataFrame:
        """Rows that no write replaces, deleted where the feed says so."""
        side = broadcast_if(marks.withColumnRenamed("id", key), touched, _MARK_BYTES)
        return (rows.join(side, key, "left").filter(~F.coalesce("written", F.lit(False)))
                .withColumn("status", F.when(F.col("deleted"), fv.DELETED).otherwise(F.col("status")))
                .drop("written", "deleted"))

    status = F.when(F.col("deleted"), fv.DELETED).otherwise(fv.ACTIVE).alias("status")
    texts = changes.select("id", "seq", "title", "content", "source_uri")
    # Rebuilt chunks get ids no chunk of the document had, so that vectors of the old ones find nothing.
    tops = chunks.select("id", "document_id").join(
        broadcast_if(marks.filter("written").select(F.col("id").alias("document_id")), touched, _MARK_BYTES),
        "document_id").groupBy("document_id").agg((F.max("id") + 1).alias("top_id"))
    known_next = F.col("others")["next_chunk_id"] if "next_chunk_id" in documents.columns else F.lit(None).cast("long")
    facts = decided.withColumnRenamed("id", "document_id").join(tops, "document_id", "left").select(
        "document_id", "deleted", F.greatest("top_id", known_next).alias("free_id"))
    facts = pin(facts, "rebuilt-documents")
    rewritten = texts.join(broadcast_if(decided.filter("seq is not null"), touched, _MARK_BYTES), ["id", "seq"]).select(
        "id", F.coalesce("new_space", "old_space").alias("space_id"), "title", "content",
        F.coalesce("new_source_type", "old_source_type", F.lit(fv.DEFAULT_SOURCE_TYPE)).alias("source_type"),
        "source_uri", status, "others")
    side = broadcast_if(facts.select(F.col("document_id").alias("id"), "free_id"), touched, _MARK_BYTES)
    counted = chunk_counts(rewritten, max_size, overlap).join(side, "id").withColumn(
        "next_chunk_id", F.coalesce("free_id", F.col("id") * CHUNK_ID_FACTOR) + F.col("chunk_count"))
    made = ["chunk_count", "next_chunk_id"]
    kept_others = [name for name in _other_columns(documents) if name not in made]
    columns = [*_DOCUMENT_COLUMNS, *kept_others]
    replaced = counted.select(*_DOCUMENT_COLUMNS, *[F.col("others")[name].alias(name) for name in kept_others], *made)
    unmade = [F.col(name) if name in documents.columns else F.lit(None).cast(replaced.schema[name].dataType).alias(name)
              for name in made]
    after = marked(documents, "id").select(*columns, *unmade).unionByName(replaced)

    columns = ["id", "document_id", "space_id", "chunk_index", "content", "char_count", "embedding_status",
               "vector_id", "status"]
    rebuilt = (chunk_documents(rewritten, max_size, overlap).drop("status").join(
        broadcast_if(facts, touched, _MARK_BYTES), "document_id")
               .withColumn("id", F.coalesce(F.col("free_id") + F.col("chunk_index"), "id")).select("*", status))
    kept = marked(chunks, "document_id")
    return Changed(after, kept.select(*columns).unionByName(rebuilt.select(*columns)), rejects)


def _other_columns(documents: DataFrame) -> list[str]:
    return [name for name in documents.columns if name not in _DOCUMENT_COLUMNS]


def change_rules() -> Column:
    """The first rule of form that a change breaks, null where it breaks none."""
    op, rules = F.col("op"), document_rules(space_required=False)
    return (F.when(op.isNull() | ~op.isin("create", "update", "delete"), "unknown operation")
            .when(F.col("id").isNull(), "id missing").when(op != "delete", F.get(_broken(rules), F.lit(0))))


def judge_changes(documents: DataFrame, changes: DataFrame, spaces: DataFrame) -> DataFrame:
    """Changes without their texts, with the document's ``old_space`` and the ``reason`` of a rejection.

    Of the documents only ids, spaces and other narrow columns are read.
    """
    active_spaces = spaces.filter(F.col("status") == fv.ACTIVE).select(
        F.col("id").alias("space_id"), F.lit(True).alias("space_ok"))
    formal = pin(changes.select("seq", "op", "id", "space_id", "source_type", change_rules().alias("rule")), "feed")
    named = pin(formal.filter("rule IS NULL").select("id").distinct(), "changed-documents")
    known = documents.select(
        "id", F.col("space_id").alias("old_space"), F.col("source_type").alias("old_source_type"),
        (F.col("status") == fv.ACTIVE).alias("was_active"),
        F.struct(F.lit(True).alias("known"), *_other_columns(documents)).alias("others"),
    ).join(broadcast_if(named, named.count(), _MARK_BYTES), "id")
    op, seq = F.col("op"), F.col("seq")
    space_needed = (op == "create") | ((op == "update") & F.col("space_id").isNotNull())
    checked = (formal.filter("rule IS NULL")
               .join(active_spaces, "space_id", "left").join(known, "id", "left")
               .withColumn("space_bad", space_needed & F.col("space_ok").isNull()))
    # A document lives from its first valid create (or from before the feed) to the first delete after that. Both
    # are minima, combined in every task, so that a document most changes name costs one row per task.
    alive = F.coalesce("was_active", F.lit(False))
    births = checked.groupBy("id").agg(F.min(
        F.when(alive, F.lit(-1).cast("long")).when((op == "create") & ~F.col("space_bad"), seq)).alias("born"))
    staged = checked.join(births, "id")
    deaths = staged.filter((op == "delete") & (seq > F.col("born"))).groupBy("id").agg(F.min("seq").alias("death"))
    reason = (
        F.when(F.col("space_bad"), "space not found")
        .when((op == "create") & (seq > F.col("born")), "document exists")
        .when(F.col("born").isNull() | (seq < F.col("born")) | (seq > F.col("death")), "document not found"))
    told = staged.join(deaths, "id", "left").select(
        "seq", "op", "id", "space_id", "source_type", "old_space", "old_source_type", "others", reason.alias("reason"))
    broken = formal.filter("rule IS NOT NULL").select("seq", "op", "id", "space_id", "source_type", F.col("rule").alias("reason"))
    return told.unionByName(broken, allowMissingColumns=True)


def soft_delete_documents(documents: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after soft-deleting the active documents of ``ids``."""
    named = pin(ids.select("id").distinct(), "deleted-documents")
    rows = named.count()
    active = documents.filter(F.col("status") == fv.ACTIVE).select("id")
    gone = active.join(broadcast_if(named, rows, _MARK_BYTES), "id").withColumn("gone", F.lit(True))

    def marked(table: DataFrame, key: str) -> DataFrame:
        side = broadcast_if(gone.withColumnRenamed("id", key), rows, _MARK_BYTES)
        return table.join(side, key, "left").withColumn(
            "status", F.when(F.col("gone"), fv.DELETED).otherwise(F.col("status"))).drop("gone")

    return marked(documents, "id"), marked(chunks, "document_id")
