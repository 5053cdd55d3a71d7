"""Results depend on each of these being exactly as written."""

# Chunking.
CHUNK_MAX_SIZE = 500
CHUNK_OVERLAP = 80
CHUNK_MIN_SIZE = 100

# Retrieval defaults and limits.
DEFAULT_TOP_K = 5
DEFAULT_CANDIDATE_K = 20
DEFAULT_VECTOR_WEIGHT = 0.7
DEFAULT_KEYWORD_WEIGHT = 0.3
VECTOR_TOP_K_MIN = 1
VECTOR_TOP_K_MAX = 20
VECTOR_FETCH_FACTOR = 3
VECTOR_FETCH_MIN = 10
VECTOR_FETCH_CAP = 60  # VECTOR_FETCH_FACTOR * VECTOR_TOP_K_MAX
ASK_TOP_K_MAX = 10
MODES = ("VECTOR_ONLY", "KEYWORD_ONLY", "HYBRID", "HYBRID_RERANK")

# Query terms.
TERM_SEPARATORS = r"[ \t\n\x0B\f\r,，。；;：:、/\\()（）\[\]{}<>]+"
TERM_MAX_LENGTH = 50
SYMBOL_CHARACTERS = (".", "/", "-", "_")
SYMBOL_SUFFIXES = ("Controller", "Service", "Mapper", "Request", "Response")

# Scores.
HIT_BONUS = 0.03
HIT_BONUS_MAX = 0.3
RERANK_HYBRID = 0.6
RERANK_EXACT = 0.25
RERANK_SYMBOL = 0.15

# Texts shown to users.
PREVIEW_LENGTH = 300
CONTEXT_LENGTH = 2000
TITLE_LENGTH = 50
UNTITLED = "Untitled session"
DEFAULT_SOURCE_TYPE = "MANUAL"
VECTOR_SOURCE = "kb_chunk"
VECTOR_ID_PREFIX = "kb_chunk_"
TASK_TYPE = "DOCUMENT_VECTORIZE"
ERROR_LENGTH = 1000
UNKNOWN_ERROR = "Unknown error"
NO_CHUNKS_MESSAGE = "No chunks found for vectorization."
SOME_FAILED_MESSAGE = "Some chunks failed during vectorization."
ALL_FAILED_MESSAGE = "All pending chunks failed during vectorization."
NO_HIT_ANSWER = "当前知识库中没有检索到足够相关的内容，因此无法基于已有知识库给出可靠回答。"

PROMPT_HEADER = (
    "You are an enterprise RAG knowledge assistant.\n"
    "Your task is to answer the user's question based only on the provided context.\n"
    "If the context is insufficient, say that the current knowledge base does not contain enough information.\n"
    "Do not fabricate facts that are not supported by the context.\n"
    "When possible, mention which references support your answer, such as [Reference 1], [Reference 2].\n"
    "\n"
    "User Question:\n"
)
PROMPT_CONTEXT = "\n\nRetrieved Context:\n"
PROMPT_FOOTER = (
    "\nAnswer Requirements:\n"
    "1. Answer in Chinese unless the user explicitly asks for another language.\n"
    "2. Keep the answer accurate, structured, and based on the retrieved context.\n"
    "3. Do not mention internal implementation details such as embeddings, vector databases, "
    "or prompt construction unless the user asks.\n"
    "4. If the answer is based on a specific reference, mark it with [Reference N].\n"
)

COMPARE_SUMMARY_HEAD = ("本次共对比 ", " 次评测运行。")
COMPARE_SUMMARY_RECALL = " Recall@K 最优的 runId 为 "
COMPARE_SUMMARY_HIT = " Hit@K 最优的 runId 为 "
COMPARE_SUMMARY_MRR = " MRR 最优的 runId 为 "
COMPARE_SUMMARY_FASTEST = " 平均延迟最低的 runId 为 "
COMPARE_SUMMARY_STOP = "。"
COMPARE_SUMMARY_TAIL = " delta 字段表示相对于第一个 runId 的变化量。"

# Status codes.
ACTIVE, DELETED = 1, 0
EMBEDDING_PENDING, EMBEDDING_DONE, EMBEDDING_FAILED = 0, 1, 2
STATUS_PENDING, STATUS_RUNNING, STATUS_SUCCESS, STATUS_FAILED, STATUS_PARTIAL = 0, 1, 2, 3, 4
STATUS_TEXT = {0: "pending", 1: "running", 2: "success", 3: "failed", 4: "partial_success"}

# Field limits (characters).
DOCUMENT_LIMITS = {"title": 255, "source_type": 64, "source_uri": 512}
SPACE_LIMITS = {"name": 100, "description": 500}
