"""Knowledge-base tables derived from the driver's test tables.

Every row is computed by Spark from the given Parquet tables with rules that plain SQL can state as well, so each
query can be checked. ``KnowledgeBase`` builds a table when it is asked for. Written are only the few spaces, the ids of
documents that are not plain, and the chunks where a query asks for that (``pin_chunks``).
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import codes, text as tx
from kbspark.operators import ingest
from kbspark.operators.contains import contains_join
from kbspark.operators.limits import broadcast_if, pin, spread
from kbspark.sources.tables import read_table, write_table

# The four languages of the test documents are the four spaces.
SPACE_OF_LANG = {"de": 1, "en": 2, "es": 3, "fr": 4}

# Bytes of a broadcast mark of a document.
_MARK_BYTES = 64

_BASE_TIME = "2024-01-01 00:00:00"


def space_of(lang: Column) -> Column:
    space = F.lit(None).cast("long")
    for name, number in SPACE_OF_LANG.items():
        space = F.when(lang == name, F.lit(number).cast("long")).otherwise(space)
    return space


def at_second(seconds: Column) -> Column:
    base = F.lit(_BASE_TIME).cast("timestamp_ntz")
    return base + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def every_space() -> Column:
    return F.explode(F.array(*[F.lit(n).cast("long") for n in SPACE_OF_LANG.values()]))


def picked_terms() -> Column:
    """Three longest distinct terms of a passage; for odd items the two longest and the first term."""
    by_length = F.transform(
        F.sort_array(F.transform(
            F.array_distinct("terms"),
            lambda term: F.struct((-F.length(term)).alias("n"), term.alias("term")))),
        lambda entry: entry["term"])
    return F.when(F.col("item_id") % 2 == 0, F.slice(by_length, 1, 3)).otherwise(
        F.concat(F.slice(by_length, 1, 2), F.slice("terms", 1, 1)))


class KnowledgeBase:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._chunks_pinned = False

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # --- content ---

    @cached_property
    def spaces(self) -> DataFrame:
        found = self.raw("documents").select("lang").distinct().select(
            space_of(F.col("lang")).alias("id"), F.col("lang").alias("name"),
            F.concat(F.lit("documents in "), "lang").alias("description"), F.lit(fv.ACTIVE).alias("status"))
        # A few rows that many branches read: the documents are scanned for them once.
        return pin(found, "spaces")

    @cached_property
    def document_requests(self) -> DataFrame:
        """Documents as they arrive: every tenth without a source type."""
        return spread(self.raw("documents").select("doc_id", "text", "lang", "source"), "doc_id").select(
            F.col("doc_id").alias("id"), space_of(F.col("lang")).alias("space_id"),
            F.substring("text", 1, 50).alias("title"), F.col("text").alias("content"),
            F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.upper("source")).alias("source_type"),
            F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("source_uri"))

    @cached_property
    def _toxic(self) -> DataFrame:
        return (self.raw("labels").filter("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
                .withColumn("toxic", F.lit(True)))

    @cached_property
    def _marks(self) -> tuple[DataFrame, int, int]:
        """``(id, toxic, copies)`` of documents that are toxic or whose id several have; rows and most copies."""
        repeated = self.raw("documents").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("copies")).filter(
            "id IS NOT NULL AND copies > 1")
        marks = pin(self._toxic.join(repeated, "id", "full_outer").select(
            "id", F.coalesce("toxic", F.lit(False)).alias("toxic"), F.coalesce("copies", F.lit(1)).cast("int").alias("copies")),
            "marked-documents")
        return marks, *marks.agg(F.count("*"), F.coalesce(F.max("copies"), F.lit(1))).first()

    @cached_property
    def documents(self) -> DataFrame:
        marks, rows, _ = self._marks
        side = broadcast_if(marks.filter("toxic").select("id", "toxic"), rows, _MARK_BYTES)
        return (ingest.prepare_documents(self.document_requests).join(side, "id", "left")
                .withColumn("status", F.when(F.col("toxic"), fv.DELETED).otherwise(fv.ACTIVE)).drop("toxic"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks with the status of their document; the few marks meet the documents, whose texts are not shuffled."""
        marks, rows, most = self._marks
        marked = self.document_requests.filter("id IS NOT NULL").join(
            broadcast_if(marks, rows, _MARK_BYTES), "id", "left").withColumn(
            "doc_status", F.when(F.col("toxic"), fv.DELETED).otherwise(fv.ACTIVE))
        cut = ingest.chunk_documents(marked, keep=["doc_status", "copies"])
        if most > 1:  # chunks go by the document's id alone: each belongs to every document that has the id
            cut = cut.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1)))))
        embedding = (F.when(F.col("id") % 17 == 3, fv.EMBEDDING_FAILED)
                     .when(F.col("id") % 13 == 5, fv.EMBEDDING_PENDING).otherwise(fv.EMBEDDING_DONE))
        return (cut.withColumns({"status": F.col("doc_status"), "embedding_status": embedding})
                .withColumn("vector_id", F.when(F.col("embedding_status") == fv.EMBEDDING_DONE,
                                                codes.vector_id(F.col("id"))))
                .select("document_id", "id", "space_id", "chunk_index", "content", "char_count", "embedding_status",
                        "vector_id", "status"))

    def pin_chunks(self) -> "KnowledgeBase":
        """Chunks from now on computed once and read back: for queries that read them in several branches."""
        if not self._chunks_pinned:
            self.chunks, self._chunks_pinned = pin(self.chunks, "chunks"), True
        return self

    def _chunk_vectors(self, chunks: DataFrame) -> DataFrame:
        embeddings = self.raw("embeddings")
        size = embeddings.agg(F.count("*")).scalar()
        return chunks.withColumn("vec_id", F.pmod(F.col("document_id") * 31 + F.col("chunk_index"), size)).join(
            embeddings, "vec_id")

    @cached_property
    def vectors(self) -> DataFrame:
        """One stored vector per vectorised chunk, active or not."""
        done = self.chunks.filter(F.col("embedding_status") == fv.EMBEDDING_DONE)
        return self._chunk_vectors(done).select(
            "vector_id", F.col("id").alias("chunk_id"), "document_id", "space_id", "chunk_index",
            F.lit(fv.VECTOR_SOURCE).alias("source"), "embedding")

    @cached_property
    def fresh_vectors(self) -> DataFrame:
        """What an embedding job returns for pending chunks: nothing where the embedding's label is 0."""
        pending = self.chunks.filter(F.col("embedding_status") == fv.EMBEDDING_PENDING)
        return self._chunk_vectors(pending).filter("label <> 0").select("id", "embedding")

    # --- requests ---

    @cached_property
    def items(self) -> DataFrame:
        with_terms = self.raw("benchmark").withColumn("terms", tx.query_terms(F.col("text")))
        return with_terms.select("item_id", "text", picked_terms().alias("keywords"))

    @cached_property
    def _asked(self) -> DataFrame:
        vector = self.raw("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vec"))
        return (self.items.join(vector, "item_id").withColumn("space_id", every_space())
                .select((F.col("item_id") * 10 + F.col("space_id")).alias("query_id"), "item_id", "space_id",
                        F.concat_ws(" ", "keywords").alias("query"), "query_vec"))

    def queries(self, mode: str, top_k: int = 5, candidate_k: int = 20, vector_weight: float = 0.6,
                keyword_weight: float = 0.4) -> DataFrame:
        """Every benchmark item asked in every space, in one mode."""
        return self._asked.withColumns({
            "retrieval_mode": F.lit(mode), "top_k": F.lit(top_k), "candidate_k": F.lit(candidate_k),
            "vector_weight": F.lit(vector_weight), "keyword_weight": F.lit(keyword_weight)})

    @cached_property
    def mixed_queries(self) -> DataFrame:
        """Every benchmark item asked in every space, with all kinds of parameters."""
        item = F.col("item_id")
        mode = (F.when(item % 5 == 0, "vector_only").when(item % 5 == 1, " KEYWORD_ONLY ")
                .when(item % 5 == 2, "HYBRID").when(item % 5 == 3, "Hybrid_Rerank").otherwise("unknown"))
        return self._asked.withColumns({
            "retrieval_mode": mode,
            "top_k": F.when(item % 11 != 0, (item % 8 - 1).cast("int")),
            "candidate_k": (item % 7 * 6).cast("int"),
            "vector_weight": (item % 4).cast("double") * 0.25 - 0.25,
            "keyword_weight": (item % 3).cast("double") * 0.3})

    # --- evaluation ---

    @cached_property
    def datasets(self) -> DataFrame:
        return self.spaces.select(
            "id", F.col("id").alias("space_id"), F.concat(F.lit("dataset-"), "name").alias("name"),
            F.lit(fv.ACTIVE).alias("status"), at_second(F.col("id")).alias("created_at"))

    @cached_property
    def cases(self) -> DataFrame:
        """One case per item and dataset; short passages are deleted cases."""
        vector = self.raw("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("query_vec"))
        return (self.items.join(vector, "item_id").withColumn("dataset_id", every_space())
                .select((F.col("dataset_id") * 100000 + F.col("item_id")).alias("id"), "dataset_id", "item_id",
                        F.concat_ws(" ", "keywords").alias("question"), F.col("text").alias("expected_answer"),
                        F.col("keywords").alias("expected_keywords"),
                        F.when(F.length("text") > 250, "hard").otherwise("easy").alias("difficulty"),
                        F.when(F.length("text") < 100, fv.DELETED).otherwise(fv.ACTIVE).alias("status"),
                        "query_vec"))

    @cached_property
    def expected(self) -> DataFrame:
        """``(case_id, chunk_id)``: active chunks of the case's space that contain its whole passage."""
        passages = self.cases.select(F.col("id").alias("case_id"), F.col("dataset_id").alias("space_id"),
                                     F.col("expected_answer").alias("passage"))
        texts = self.chunks.filter(F.col("status") == fv.ACTIVE).select(
            F.col("id").alias("chunk_id"), "space_id", F.col("content").alias("text"))
        found = contains_join(texts, passages, "text", "passage", group="space_id", key="chunk_id", by_bytes=True)
        return found.select("case_id", "chunk_id")

    @cached_property
    def runs(self) -> DataFrame:
        """Four runs per dataset, one per mode; the hybrid ones generate answers."""
        modes = F.posexplode(F.array(*[F.lit(mode) for mode in fv.MODES])).alias("position", "retrieval_mode")
        return self.datasets.select(F.col("id").alias("dataset_id"), modes).select(
            (F.col("dataset_id") * 10 + F.col("position") + 1).alias("id"), "dataset_id",
            F.concat(F.lit("run-"), F.lower("retrieval_mode")).alias("run_name"), "retrieval_mode",
            F.lit(5).alias("top_k"), F.lit(20).alias("candidate_k"), F.lit(0.6).alias("vector_weight"),
            F.lit(0.4).alias("keyword_weight"), (F.col("position") >= 2).alias("enable_answer_generation"))

    # --- history ---

    @cached_property
    def messages(self) -> DataFrame:
        talk = self.raw("conversations")
        message = F.col("conv_id") * 1000 + F.col("turn")
        return talk.select(
            message.alias("id"), F.col("conv_id").alias("session_id"),
            (F.col("conv_id") % 4 + 1).alias("space_id"), "role", F.col("text").alias("content"),
            at_second(message).alias("created_at"))

    @cached_property
    def sessions(self) -> DataFrame:
        """One session per conversation, titled by its first message; deleted when a system message opens it."""
        talk = self.raw("conversations")
        opening = talk.groupBy("conv_id").agg(
            F.min("turn").alias("turn"), F.max("turn").alias("last_turn"))
        return talk.join(opening, ["conv_id", "turn"]).select(
            F.col("conv_id").alias("id"), (F.col("conv_id") % 4 + 1).alias("space_id"),
            tx.session_title(F.col("text")).alias("title"),
            F.when(F.col("role") == "system", fv.DELETED).otherwise(fv.ACTIVE).alias("status"),
            at_second(F.col("conv_id")).alias("created_at"),
            at_second(F.col("conv_id") * 1000 + F.col("last_turn")).alias("updated_at"))

    @cached_property
    def references(self) -> DataFrame:
        """The first three chunks of one document per assistant message; none for every other turn."""
        size = self.raw("documents").agg(F.count("*")).scalar()
        cited = self.chunks.filter("chunk_index < 3").select(
            F.col("id").alias("chunk_id"), "document_id", F.col("space_id").alias("chunk_space"), "chunk_index",
            tx.preview(F.col("content")).alias("content_preview"))
        answers = (self.messages.filter("role = 'assistant' and id % 4 <> 3")
                   .withColumn("document_id", F.pmod(F.col("session_id"), size)))
        return answers.join(cited, "document_id").select(
            (F.col("id") * 10 + F.col("chunk_index") + 1).alias("id"), F.col("id").alias("message_id"), "session_id",
            (F.col("chunk_index") + 1).alias("reference_index"), "chunk_id", "document_id",
            F.col("chunk_space").alias("space_id"), "chunk_index",
            (1.0 / (F.col("chunk_index") + 1)).alias("score"), "content_preview", "created_at")

    @cached_property
    def outcomes(self) -> DataFrame:
        return self.outcomes_of(self.raw("events"))

    @staticmethod
    def outcomes_of(events: DataFrame) -> DataFrame:
        """Chunk outcomes told by the event type."""
        outcome = (F.when(F.col("event_type") == "error", "failed")
                   .when(F.col("event_type").isin("view", "click"), "skipped").otherwise("success"))
        return events.select("event_id", F.col("user_id").alias("document_id"), outcome.alias("outcome"), "ts")

    # --- change feeds ---

    @cached_property
    def changes(self) -> DataFrame:
        """Document changes told by the conversations: a user's turn updates, a system's deletes a document.

        A document is named by the conversation number, so conversations beyond the documents name unknown ones. The
        first turns also send changes that break a rule of form.
        """
        number = F.col("conv_id") % 4
        broken = self.raw("conversations").filter("turn = 1").select(
            (F.col("conv_id") + 9_000_000_000).alias("seq"),
            F.when(number == 0, "update").when(number == 1, "create").when(number == 2, "upsert").alias("op"),
            F.when(number != 3, F.col("conv_id") * 3).alias("id"), F.lit(1).cast("long").alias("space_id"),
            F.when(number == 0, " ").when(number == 1, F.repeat(F.lit("t"), F.lit(400))).otherwise("title").alias("title"),
            F.when(number == 0, "\n").otherwise(F.col("text")).alias("content"), F.lit("").alias("source_type"),
            F.concat(F.lit("chat://"), F.col("conv_id").cast("string")).alias("source_uri"))
        return broken.unionByName(self.raw("conversations").select(
            (F.col("turn") * 1000000 + F.col("conv_id")).alias("seq"),
            F.when(F.col("role") == "system", "delete").otherwise("update").alias("op"),
            (F.col("conv_id") * 3).alias("id"),
            F.when(F.col("turn") % 2 == 1, F.col("conv_id") % 5 + 1).alias("space_id"),
            F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"),
            F.when(F.col("turn") > 1, F.concat(F.lit("CHAT"), F.col("turn").cast("string")))
            .otherwise("").alias("source_type"),
            F.concat(F.lit("chat://"), F.col("conv_id").cast("string")).alias("source_uri")))

    @cached_property
    def named_spaces(self) -> DataFrame:
        """One space per (language, source), so that names repeat across languages."""
        pairs = self.raw("documents").select("lang", "source").distinct()
        return pairs.select(
            (space_of(F.col("lang")) * 100 + F.substring("source", 4, 9).cast("long")).alias("id"),
            F.col("source").alias("name"), F.concat(F.lit("documents in "), "lang").alias("description"),
            F.when(F.col("lang") == "en", fv.ACTIVE).otherwise(fv.DELETED).alias("status"))

    @cached_property
    def space_requests(self) -> DataFrame:
        """Requests to take the upper-case name of the source, or the plain one, per (language, source)."""
        return self.named_spaces.select(
            "id", F.when(F.col("id") % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("name"),
            F.concat(F.lit("renamed "), "name").alias("description"))


class StoredKnowledgeBase(KnowledgeBase):
    """The same tables, with the content tables read from where ``store`` wrote them."""

    def __init__(self, spark: SparkSession, sf_dir: str, root: str):
        super().__init__(spark, sf_dir)
        self.root = root

    def _stored(self, name: str) -> DataFrame:
        return read_table(self.spark, self.root, name)

    spaces = cached_property(lambda self: self._stored("kb_space"))
    documents = cached_property(lambda self: self._stored("kb_document"))
    chunks = cached_property(lambda self: spread(self._stored("kb_chunk"), "id"))
    vectors = cached_property(lambda self: spread(self._stored("chunk_vector"), "chunk_id"))

    def pin_chunks(self) -> "StoredKnowledgeBase":
        return self


def store(kb: KnowledgeBase, root: str) -> None:
    """Write the content tables of a knowledge base."""
    write_table(kb.spaces, root, "kb_space")
    write_table(kb.documents, root, "kb_document")
    write_table(kb.chunks, root, "kb_chunk")
    write_table(kb.vectors, root, "chunk_vector")
