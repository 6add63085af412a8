"""Encode whole texts word by word, through a bounded cache of words already encoded.

A byte-level BPE never merges across the pieces of its pre-tokenizer, and a single space, or a single line feed, between
two non-white characters always begins a new piece (that of the space takes the next word along). So a text may
be cut before each of them and the parts encoded apart; their ids, put together, are the text's.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")
#: Whether each byte up to the space is white, and the second (and third) bytes of longer white characters by their first; how many bytes these have.
_LOW_WHITE = np.array([chr(i).isspace() for i in range(33)])
_WIDE_WHITE = {0xC2: [0x85, 0xA0], 0xE1: [0x9A80], 0xE2: [*range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F], 0xE3: [0x8080]}
_WIDE_LEADS = {head: 2 if head < 0xE0 else 3 for head in _WIDE_WHITE}


_KEPT: list[dict] = []


def kept() -> dict:
    """A dictionary of what a Python worker keeps between tasks, until an operator that needs the memory lets it go."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """Empty what is kept, and give its memory back to the system."""
    if any(_KEPT):
        for held in _KEPT:
            held.clear()
        trim()


def trim() -> None:
    """Give memory that this worker no longer uses back to the system: it lives on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def cut(text: str) -> list[str]:
    """Parts of ``text``; every part but the first begins with its line feed, or has lost the space before it."""
    return _CUT.split(text)


def _white(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes up to the space, and whether each byte of UTF-8 begins or ends a white character, with a false value after the last."""
    low = np.flatnonzero(data <= 32)
    white = np.zeros(len(data) + 1, bool)
    white[low] = _LOW_WHITE[data[low]]
    if len(data) and data.max() > 127:
        for head, size in _WIDE_LEADS.items():
            at = np.flatnonzero(data[:len(data) - size + 1] == head)
            if len(at):
                code = data[at + 1].astype(np.int64)
                if size == 3:
                    code = code << 8 | data[at + 2]
                at = at[np.isin(code, _WIDE_WHITE[head])]
                white[at] = white[at + size - 1] = True
    return low, white


def cut_column(column: pa.Array, signs: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts that ``cut`` gives for each text of a column (null: empty), one after another; the places of texts' first parts among them, and of the others.

    With ``signs`` also before each of them that follows an ASCII letter; then a part that begins with a sign after a space keeps the space."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, held = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(held or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    low, white = _white(data)
    edge = np.zeros(len(data) + 2, bool)
    edge[ends] = True
    cuts = low[(data[low] == 32) | (data[low] == 10)]
    cuts = cuts[~(edge[cuts] | edge[cuts + 1] | white[cuts - 1] | white[cuts + 1])]
    spaces = data[cuts] == 32
    if signs:
        sign = np.zeros(len(data) + 1, bool)
        for c in signs.encode():
            sign[:-1] |= data == c
        after = np.flatnonzero(sign)
        letter = data[after - 1] | 32
        after = after[(letter >= 97) & (letter <= 122) & ~edge[after]]
        begins = np.zeros(len(data), bool)
        begins[cuts] = begins[after] = True
        cuts = np.flatnonzero(begins)
        spaces = (data[cuts] == 32) & ~sign[cuts + 1]
    stays = np.ones(len(data), bool)
    stays[cuts[spaces]] = False
    gone = np.r_[0, np.cumsum(spaces)]
    before = np.searchsorted(cuts, ends)
    heads = before[:-1] + np.arange(len(column))
    inner = np.arange(len(cuts)) + np.repeat(np.arange(1, len(column) + 1), np.diff(before))
    starts = np.empty(len(heads) + len(inner) + 1, np.int64)
    starts[heads] = ends[:-1] - gone[before[:-1]]
    starts[inner] = cuts - gone[:-1]
    starts[-1] = len(data) - gone[-1]
    return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data[stays])]), heads, inner


class WordCache:
    """``encode`` gives the ids of each part as little-endian 32-bit bytes; its parts begin with a
    space or a line feed before something that is not white. ``encode_firsts`` (if another) does so for texts' first parts, which may be anything.

    The cache holds two generations of at most ``limit`` parts; parts longer than ``longest``
    characters are never kept. So its memory is bounded, whatever the input. With ``signs`` (ASCII) texts are also cut before
    each of them after an ASCII letter, so that a word is the same part with and without them; such parts begin with the sign.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], encode_firsts: Callable[[list[str]], Iterable[bytes]] | None = None,
                 limit: int = 400_000, longest: int = 48, signs: str = ""):
        self.signs, self.bare = signs, frozenset("\n " + signs)
        self.encode_parts, self.encode_firsts, self.limit, self.longest = encode, encode_firsts or encode, limit, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str], tail: bytes = b"") -> list[bytes]:
        """The ids of each text, and ``tail`` after them."""
        ends, flat = self.encode_column(pa.array(texts, pa.large_string()), tail)
        at = ends.tolist()
        return [bytes(flat[i:j]) for i, j in zip([0, *at], at, strict=False)]

    def encode_column(self, column: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, memoryview]:
        """Where each text's ids (null: none) and ``tail`` end in the bytes of them all, and these bytes. No text becomes a Python string, and each different part is looked up once."""
        if not len(column):
            return np.zeros(0, np.int64), memoryview(b"")
        parts, heads, inner = cut_column(column, self.signs)
        long: set[str] = set()
        firsts = self.encode_firsts(parts.take(pa.array(heads)).to_pylist())
        later = np.ones(len(parts), bool)
        later[heads] = False
        # heads are null to the numbering, which leaves them out
        valid = pa.py_buffer(np.packbits(later, bitorder="little"))
        numbered = pa.Array.from_buffers(parts.type, len(parts), [valid, *parts.buffers()[1:]]).dictionary_encode()
        ids = [*self._ids(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), long), *firsts, tail]
        # each text: its head, its other parts, the tail
        texts = np.arange(len(heads))
        order = np.full(len(parts) + len(heads), len(ids) - 1, np.int64)
        order[heads + texts] = len(ids) - 1 - len(heads) + texts
        order[inner + np.repeat(texts, np.diff(np.r_[heads, len(parts)]) - 1)] = numbered.indices.take(pa.array(inner)).to_numpy()
        joined = pa.array(ids, pa.large_binary()).take(pa.array(order))
        ends = np.frombuffer(joined.buffers()[1], np.int64, len(order) + 1)[np.r_[heads[1:] + texts[1:], len(order)]]
        for w in long:
            del self.young[w]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        return ends, memoryview(joined.buffers()[2] or b"")

    def _ids(self, parts: list[str], long: set[str]) -> list[bytes]:
        """The ids of each part; new ones are encoded and kept, and those too long to stay are added to ``long``."""
        known, old = self.young, self.old
        found = list(map(known.get, parts))
        if None not in found:
            return found
        missed = {w for w, x in zip(parts, found, strict=True) if x is None}
        again = [w for w in missed if w in old]
        known.update((w, old[w]) for w in again)
        missed.difference_update(again)
        new = list(missed)
        known.update(zip(new, self.encode_parts([w if w[0] in self.bare else " " + w for w in new]), strict=True))
        long.update(w for w in new if len(w) > self.longest)
        return [known[w] if x is None else x for w, x in zip(parts, found, strict=True)]


def blocks(texts: list[str], most: int = 1_000_000) -> Iterable[slice]:
    """Slices of about ``most`` characters, one text at least."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(at, i)
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


def column_blocks(column: pa.Array, most: int = 1_000_000) -> Iterator[slice]:
    """Slices of a column of texts of about ``most`` bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    at = size = 0
    for i, n in enumerate([*sizes, None]):
        if i > at and (n is None or size + n > most):
            yield slice(at, i)
            at, size = i, 0
        size += n or 0


def text_blocks(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[slice, list[str]]]:
    """Slices as ``column_blocks`` has them, and their texts (null: empty); no others become Python strings."""
    for s in column_blocks(column, most):
        yield s, [t or "" for t in column.slice(s.start, s.stop - s.start).to_pylist()]
