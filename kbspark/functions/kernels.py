"""NumPy block kernel of the nearest-vector search: scores one Arrow batch of vectors against many queries.

Only the best ``fetch`` hits per query leave a task, so scored pairs never become rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from kbspark.functions.scores import DIGITS

# Largest number of scores held at once (rows of a query block times rows of a batch).
BLOCK_SCORES = 4_000_000

# Largest count of vector elements turned into floating-point rows at once.
BLOCK_NUMBERS = 4_000_000

_SCALE = 10.0 ** DIGITS


def unit_rows(lists: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit-length rows of the non-null vectors; a zero vector stays zero."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    keep = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    lists = lists.drop_null()
    if len(lists) == 0:
        return keep, np.empty((0, 0))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return keep, np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors hold at most ``BLOCK_NUMBERS`` numbers."""
    width = max(1, len(batch.column("embedding").flatten()) // max(1, batch.num_rows))
    step = max(1, BLOCK_NUMBERS // width)
    return (batch.slice(first, step) for first in range(0, batch.num_rows, step))


class TopHits:
    """Running best hits of a fixed set of queries, as flat arrays sorted by query, score and chunk id."""

    def __init__(self, rows: np.ndarray, fetch: np.ndarray):
        self.rows = rows
        self.fetch = fetch
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.chunk = np.empty(0, np.int64)
        self.bar = np.full(len(rows), -np.inf)

    def add(self, chunk_ids: np.ndarray, vectors: np.ndarray) -> None:
        if not len(vectors) or not len(self.rows):
            return
        found = [(self.query, self.score, self.chunk)]
        step = max(1, BLOCK_SCORES // len(vectors))
        for first in range(0, len(self.rows), step):
            part = slice(first, first + step)
            scores = np.rint(self.rows[part] @ vectors.T * _SCALE) / _SCALE
            most = int(self.fetch[part].max())
            bar = self.bar[part]
            if most < scores.shape[1]:
                bar = np.maximum(bar, -np.partition(-scores, most - 1, axis=1)[:, most - 1])
            query, column = np.nonzero(scores >= bar[:, None])
            found.append((query + first, scores[query, column], chunk_ids[column]))
        query, score, chunk = (np.concatenate(parts) for parts in zip(*found))
        order = np.lexsort((chunk, -score, query))
        query, score, chunk = query[order], score[order], chunk[order]
        starts = np.searchsorted(query, np.arange(len(self.rows)))
        place = np.arange(len(query)) - starts[query]
        keep = place < self.fetch[query]
        last = place == self.fetch[query] - 1
        self.bar[query[last]] = score[last]
        self.query, self.score, self.chunk = query[keep], score[keep], chunk[keep]


class QueryMatrix:
    """A bounded table of queries ``(probe_id, space_id, fetch_k, query_vec)``, one unit matrix per space."""

    def __init__(self, queries: pa.Table):
        keep, rows = unit_rows(queries.column("query_vec"))
        queries = queries.take(pa.array(keep))
        self.probes = queries.column("probe_id").combine_chunks()
        space = queries.column("space_id").to_numpy()
        fetch = queries.column("fetch_k").to_numpy().astype(np.int64)
        self.spaces = {}
        for value in np.unique(space):
            at = np.flatnonzero(space == value)
            self.spaces[int(value)] = (at, rows[at], fetch[at])

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best hits within the given batches of ``(space_id, chunk_id, embedding)``."""
        state = {}
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            keep, vectors = unit_rows(batch.column("embedding"))
            space = batch.column("space_id").to_numpy(zero_copy_only=False)[keep]
            chunk = batch.column("chunk_id").to_numpy(zero_copy_only=False)[keep].astype(np.int64)
            for value in np.unique(space):
                if int(value) not in self.spaces:
                    continue
                _, rows, fetch = self.spaces[int(value)]
                hits = state.setdefault(int(value), TopHits(rows, fetch))
                at = space == value
                hits.add(chunk[at], vectors[at])
        for value, hits in state.items():
            probe = self.probes.take(pa.array(self.spaces[value][0][hits.query]))
            yield pa.RecordBatch.from_arrays(
                [probe, pa.array(hits.chunk), pa.array(hits.score)],
                names=["probe_id", "chunk_id", "vector_score"])
