"""Simple-8b: as many ids in a 64-bit word as the widest of them allows, with numpy.

The top four bits of a word are its selector, the other 60 hold the ids, the first in the lowest bits.
Selector 0 is an escape: the next word is one id of up to 64 bits as it is. Sequences start on a word of
their own; the last word of a sequence may have room to spare (read as zeros and cut by its length).
"""

from __future__ import annotations

import numpy as np

# fixed values: ids in a word and bits of an id, for selectors 1 to 14
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_COUNT_OF = np.array((0, *COUNTS, 0), np.int64)


def encode(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` (uint64) of several sequences, one after the other, each ending before its ``ends``.

    Returns the words, the number of words of each sequence, and the places of the escapes.
    """
    total = len(ids)
    lengths = np.diff(ends, prepend=0)
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64), np.empty(0, np.int64)
    places = np.arange(total, dtype=np.int64)
    room = np.repeat(ends, lengths) - places
    chosen = _selectors(ids, lengths)
    steps = np.minimum(_COUNT_OF[chosen], room)
    steps[chosen == 0] = 1
    follow = (places + steps).tolist()
    starts: list[int] = []
    add, at = starts.append, 0
    while at < total:
        add(at)
        at = follow[at]
    begin = np.array(starts, np.int64)
    selectors = chosen[begin]
    # an escape takes two words
    size = np.where(selectors == 0, 2, 1)
    offset = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    taken = steps[begin]
    for selector, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        mine = np.flatnonzero(selectors == selector)
        if not len(mine):
            continue
        word = np.full(len(mine), selector << 60, np.uint64)
        from_, many = begin[mine], taken[mine]
        for k in range(count):
            inside = many > k
            if not inside.all():
                part = np.flatnonzero(inside)
                if not len(part):
                    break
                word[part] |= ids[from_[part] + k] << np.uint64(k * bits)
            else:
                word |= ids[from_ + k] << np.uint64(k * bits)
        words[offset[mine]] = word
    escapes = offset[selectors == 0]
    words[escapes + 1] = ids[begin[selectors == 0]]
    # words up to each sequence's end
    upto = np.append(offset, len(words))[np.searchsorted(begin, ends, side="left")]
    return words, np.diff(upto, prepend=0), escapes


def _selectors(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each place the first selector, from narrow to wide, of which all ids that its word would hold (up to the end
    of the sequence) are narrow enough; 0 for an id of more than 60 bits."""
    if int(ids.max()) < 1 << 32:
        ids = ids.astype(np.uint32)
    # the selector an id needs; sequences with room after them, where narrow ids stand
    gap = max(COUNTS)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(lengths)) * gap, lengths)
    need = np.zeros(len(ids) + (len(lengths) + 1) * gap, np.uint8)
    kind = np.ones(len(ids), np.uint8)
    for bits in BITS:
        if 1 << bits > np.iinfo(ids.dtype).max:
            break
        kind += ids >= ids.dtype.type(1 << bits)
    need[at] = kind
    # widest[p][i]: the widest need of p places from i on, for powers of two
    widest, reach = {1: need}, 1
    while reach * 2 <= gap:
        last = widest[reach]
        widest[reach * 2] = last.copy()
        np.maximum(last[:-reach], last[reach:], out=widest[reach * 2][:-reach])
        reach *= 2
    chosen = np.zeros(len(need), np.uint8)
    for selector in range(len(COUNTS), 0, -1):
        count = COUNTS[selector - 1]
        part = 1 << (count.bit_length() - 1)
        most = widest[part]
        if count > part:
            most = np.maximum(most[: len(most) - count + part], most[count - part :])
        chosen[: len(most)][most <= selector] = selector
    return chosen[at]


def decode(words: np.ndarray, escapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids the words have room for, and where the ids of each word start (one more at the end)."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    selectors[escapes] = 0
    counts = _COUNT_OF[selectors]
    counts[escapes + 1] = 1
    selectors[escapes + 1] = 15
    starts = np.concatenate([[0], np.cumsum(counts)])
    ids = np.zeros(int(starts[-1]), np.uint64)
    for selector, (count, bits) in enumerate(zip(COUNTS, BITS, strict=True), 1):
        mine = np.flatnonzero(selectors == selector)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[mine, None] >> shifts) & np.uint64((1 << bits) - 1)
            ids[starts[mine, None] + np.arange(count)] = values
    ids[starts[escapes + 1]] = words[escapes + 1]
    return ids, starts
