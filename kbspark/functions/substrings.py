"""NumPy kernel of the substring join: finds many patterns in the texts of one Arrow batch.

Texts lie side by side as bytes. A pattern is looked for by its first ``w`` bytes, the most of 8, 4, 2 or 1 that it has:
the ``w`` bytes at every place of the texts are read as one number, a bit field drops the places where no pattern
starts, and the rest are looked up. The last ``w`` bytes have to be equal too, which is all of a pattern of up to ``2w``
bytes; longer ones are compared whole. Equal bytes are equal letters in UTF-8.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTHS = (8, 4, 2, 1)

# Bytes of texts that are looked at together; a longer text is looked at by itself.
BLOCK_BYTES = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(data: np.ndarray) -> dict[int, np.ndarray]:
    """For each width the bytes from every place on as one number; ``data`` has seven bytes more at its end."""
    size, out = len(data) - 7, {1: data.astype(np.uint64)}
    for width in (1, 2, 4):
        known = out[width]
        out[2 * width] = known[:len(known) - width] | known[width:] << np.uint64(8 * width)
    return {width: array[:size] for width, array in out.items()}


class _OfWidth:
    """The patterns that are looked for by ``width`` bytes."""

    def __init__(self, width: int, numbers: np.ndarray, patterns: list[bytes]):
        self.width = width
        first = np.array([int.from_bytes(patterns[n][:width], "little") for n in numbers], np.uint64)
        order = np.argsort(first, kind="stable")
        self.numbers, self.first = numbers[order], first[order]
        self.last = np.array([int.from_bytes(patterns[n][-width:], "little") for n in self.numbers], np.uint64)
        self.sizes = np.array([len(patterns[n]) for n in self.numbers], np.int64)
        self.shift = np.uint64(64 - min(22, max(16, len(numbers).bit_length() + 6)))
        self.field = np.zeros(1 << (64 - int(self.shift)), bool)
        self.field[self.first * _MIX >> self.shift] = True

    def starts(self, numbers: np.ndarray, ends: np.ndarray, patterns: list[bytes], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of patterns; ``ends`` is where the text of each place ends."""
        places = np.flatnonzero(self.field[numbers * _MIX >> self.shift])
        low = np.searchsorted(self.first, numbers[places], "left")
        count = np.searchsorted(self.first, numbers[places], "right") - low
        at = np.repeat(places, count)
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(len(at))
        size = self.sizes[entry]
        inside = at + size <= ends[at]
        at, entry, size = at[inside], entry[inside], size[inside]
        same = numbers[at + size - self.width] == self.last[entry]
        at, entry, size = at[same], entry[same], size[same]
        long = np.flatnonzero(size > 2 * self.width)
        wrong = [n for n in long if raw[at[n]:at[n] + size[n]] != patterns[self.numbers[entry[n]]]]
        return np.delete(at, wrong), self.numbers[np.delete(entry, wrong)]


class Patterns:
    """Patterns by group: ``(group, pattern, number)``, patterns not empty, ``number`` counts the rows from 0."""

    def __init__(self, table: pa.Table):
        groups = table.column(0).to_pylist()
        texts = [text.encode() for text in table.column(1).to_pylist()]
        self.texts = sorted(set(texts))
        self.groups = {group: n for n, group in enumerate(dict.fromkeys(groups))}
        place = {text: n for n, text in enumerate(self.texts)}
        codes = np.array([place[text] * len(self.groups) + self.groups[group] for text, group in zip(texts, groups, strict=True)], np.int64)
        order = np.argsort(codes)
        self.codes, self.rows = codes[order], np.array(table.column(2).to_pylist(), np.int64)[order]
        self.by_width = []
        high = None
        for width in WIDTHS:
            own = np.array([n for n, text in enumerate(self.texts) if len(text) >= width and (high is None or len(text) < high)], np.int64)
            if len(own):
                self.by_width.append(_OfWidth(width, own, self.texts))
            high = width

    def found(self, texts: pa.Array, groups: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts and the numbers of the patterns in them, each pair once, in the order of the texts."""
        kinds = groups.dictionary_encode()
        known = np.array([self.groups.get(value, -1) for value in kinds.dictionary.to_pylist()] + [-1], np.int64)
        group = known[kinds.indices.fill_null(len(kinds.dictionary)).to_numpy(zero_copy_only=False)]
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for first, piece in _pieces(texts.cast(pa.large_string()).fill_null("")):
            text, pattern = self._in_piece(piece)
            home = group[text + first]
            wanted = pattern * len(self.groups) + home
            place = np.minimum(np.searchsorted(self.codes, wanted), max(0, len(self.codes) - 1))
            has = (home >= 0) & (self.codes[place] == wanted) if len(self.codes) else np.zeros(len(wanted), bool)
            parts.append((text[has] + first, self.rows[place[has]]))
        return tuple(np.concatenate(arrays) for arrays in zip(*parts, strict=True))

    def _in_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        start, size = int(offsets[0]), int(offsets[-1] - offsets[0])
        if not size or not self.by_width:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        raw = texts.buffers()[2][start:start + size].to_pybytes()
        numbers = windows(np.frombuffer(raw + bytes(7), np.uint8))
        lengths = np.diff(offsets)
        ends, owner = np.repeat(offsets[1:] - start, lengths), np.repeat(np.arange(len(texts)), lengths)
        found = [one.starts(numbers[one.width], ends, self.texts, raw) for one in self.by_width]
        pairs = np.unique(np.concatenate([owner[at] * len(self.texts) + pattern for at, pattern in found]))
        return np.divmod(pairs, len(self.texts))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``BLOCK_BYTES``, with the place of the first one."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1)
        yield first, texts.slice(first, last - first)
        first = last


def lowest(keys: np.ndarray, patterns: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` lowest keys of each pattern."""
    order = np.lexsort((keys, patterns))
    starts = np.flatnonzero(np.diff(patterns[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    return order[place < most]
