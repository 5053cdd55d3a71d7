"""NumPy kernel of the stored grams: the lists of a few thousand texts at once, without a row per gram and text."""

import numpy as np
import pyarrow as pa

# Letters of texts that are looked at together; a longer text is looked at by itself.
BLOCK_LETTERS = 1 << 20

# Letters are numbered among the different letters of a block, from 1; 0 stands for the end of a text.
_MOST = (1 << 16) - 1

SIZE = 4

# Ids are packed as steps between multiples of this number, and what is above these; chunk ids of a document lie so together.
_DOCUMENT = 1_000_000


def lists(ids: np.ndarray, texts: list[str]) -> list[tuple[list[str], pa.Array]]:
    """Blocks of ``(grams, lists of ids)``: the ``SIZE`` letters from every place of a text, fewer at its end.

    Grams of a block are different, their ids sorted and without repeats.
    """
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[n] for n in order]
    ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
    out, first = [], 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_LETTERS, "right")))
        out += _block(ids[first:last], texts[first:last])
        first = last
    return out


def _block(ids: np.ndarray, texts: list[str]) -> list[tuple[list[str], pa.Array]]:
    sizes = np.array([len(text) for text in texts], np.int64)
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(letters):
        return []
    seen = np.zeros(0x110000, bool)
    seen[letters] = True
    alphabet = np.flatnonzero(seen)
    new = np.append(True, ids[1:] != ids[:-1])
    different_ids = ids[new]
    # A gram and the place of its text's id make one number, so that one sort brings them into order.
    bits, low = len(alphabet).bit_length(), (len(different_ids) - 1).bit_length()
    if len(alphabet) > _MOST or SIZE * bits + low > 64:
        if len(texts) == 1:
            return _plain(ids, texts)
        half = len(texts) // 2
        return _block(ids[:half], texts[:half]) + _block(ids[half:], texts[half:])
    number = np.cumsum(seen, dtype=np.uint32)
    # Ends after each text, so that no gram goes on into the next one.
    spread = np.zeros(len(letters) + (SIZE - 1) * len(texts), np.uint64)
    at = np.arange(len(letters)) + np.repeat(np.arange(len(texts)) * (SIZE - 1), sizes)
    spread[at] = number[letters]
    gram = spread[:len(spread) - SIZE + 1]
    for n in range(1, SIZE):
        gram = gram << np.uint64(bits) | spread[n:len(spread) - SIZE + 1 + n]
    both = gram[at] << np.uint64(low) | np.repeat(np.cumsum(new).astype(np.uint64) - np.uint64(1), sizes)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])]
    gram, place = both >> np.uint64(low), both & np.uint64((1 << low) - 1)
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    lists_of = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)).astype(np.int32)), pa.array(different_ids[place.astype(np.int64)]))
    different = gram[starts]
    codes = np.concatenate([[0], alphabet]).astype(np.uint32)
    parts = np.stack([(different >> np.uint64(bits * (SIZE - 1 - n))) & np.uint64((1 << bits) - 1) for n in range(SIZE)], axis=1).astype(np.int64)
    lengths = (parts > 0).sum(axis=1)
    joined = codes[parts[parts > 0]].tobytes().decode("utf-32-le", "surrogatepass")
    stops = np.cumsum(lengths)
    return [([joined[a:b] for a, b in zip((stops - lengths).tolist(), stops.tolist(), strict=True)], lists_of)]


def _plain(ids: np.ndarray, texts: list[str]) -> list[tuple[list[str], pa.Array]]:
    """The same of one text that has too many different letters to number them."""
    grams = sorted({texts[0][n:n + SIZE] for n in range(len(texts[0]))})
    return [(grams, pa.array([[int(ids[0])]] * len(grams), pa.list_(pa.int64())))]


def packed(found: pa.Array, lowest: int) -> pa.Array:
    """Lists of sorted ids without repeats, none of them empty or below ``lowest``, as bytes: mostly one or two for an id.

    An even number is a step to a later document, an odd one a step to a later id inside it; seven bits make a byte.
    """
    starts = found.offsets.to_numpy().astype(np.int64)
    ids = found.values.to_numpy()[starts[0]:starts[-1]]
    starts = starts - starts[0]
    document, inside = ids // _DOCUMENT, ids % _DOCUMENT
    first = np.zeros(len(ids), bool)
    first[starts[:-1]] = True
    step = np.diff(document, prepend=0)
    step[first] = document[first] - lowest // _DOCUMENT
    moved = first | (step > 0)
    on = np.diff(inside, prepend=0)
    on[moved] = inside[moved]
    after = np.cumsum(moved + 1)  # the numbers up to an id
    numbers = np.zeros(after[-1] if len(ids) else 0, np.uint64)
    numbers[after - 1] = on << 1 | 1
    numbers[after[moved] - 2] = step[moved] << 1
    sizes = np.ones(len(numbers), np.int64)
    for n in range(1, 10):
        longer = numbers >= np.uint64(1 << 7 * n)
        if not longer.any():
            break
        sizes += longer
    ends = np.cumsum(sizes)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for n in range(sizes.max(initial=0)):
        has = sizes > n
        out[(ends - sizes)[has] + n] = numbers[has] >> np.uint64(7 * n) & np.uint64(127) | np.where(sizes[has] > n + 1, 128, 0).astype(np.uint64)
    offsets = np.append(0, ends)[np.append(0, after)[starts]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(lists_of: pa.Array, lowest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, sizes)``: the ids of all packed lists one after the other, and how many each list has."""
    if not len(lists_of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists_of = lists_of.cast(pa.binary())
    offsets = np.frombuffer(lists_of.buffers()[1], np.int32)[lists_of.offset:lists_of.offset + len(lists_of) + 1].astype(np.int64)
    held = np.frombuffer(lists_of.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    stops = np.flatnonzero(held < 128)
    starts = np.append(0, stops[:-1] + 1)
    sizes = stops - starts + 1
    numbers = np.zeros(len(stops), np.uint64)
    for n in range(sizes.max(initial=0)):
        has = sizes > n
        numbers[has] |= (held[starts[has] + n] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * n)
    inside, amount = (numbers & np.uint64(1)).astype(bool), (numbers >> np.uint64(1)).astype(np.int64)
    bounds = np.append(0, np.cumsum(held < 128))[offsets]  # the numbers before each list
    document = np.cumsum(np.where(inside, 0, amount))
    before = np.append(0, document)[bounds[:-1]]
    document += np.repeat(lowest // _DOCUMENT - before, np.diff(bounds))
    within = np.cumsum(np.where(inside, amount, 0))
    # Every list begins with a step to a document.
    within -= within[np.maximum.accumulate(np.where(inside, 0, np.arange(len(inside))))]
    return (document * _DOCUMENT + within)[inside], np.diff(np.append(0, np.cumsum(inside))[bounds])
