"""Quality rules with suffix-array repetition.

The words of many texts are sorted as suffixes at once, by prefix doubling in numpy; a suffix ends
with its text. From the ranks kept for each doubling the longest common prefix of neighbouring
suffixes follows without a scan. A suffix at place r of the array lies in its deepest LCP interval with
the value max(lcp[r], lcp[r + 1]): that many words from it on are found elsewhere in the text too. The
spans that no longer span holds are the occurrences of the maximal repeated substrings. The union of the
spans of at least ``min_words`` words, and the longest span, are what the verdict limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, packed, schema_with, ship_code, unpacked
from .word_cache import text_blocks

#: Limits of the base rules: fewest words; percent of words in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 50, 50, 3
_SYMBOLS = b"#*$%&|<>"


def lcp_spans(tokens: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """For each token the length of the longest run from it on that its text holds more than once.

    ``tokens`` are non-negative numbers, ``text_of`` numbers the texts in order; runs end with their text.
    """
    n = len(tokens)
    if n < 2:
        return np.zeros(n, np.int32)
    bounds = np.flatnonzero(np.diff(text_of)) + 1
    lengths = np.diff(np.r_[0, bounds, n])
    end_of = np.repeat(np.cumsum(lengths), lengths)
    # A rank is the number of suffixes with a smaller prefix. Texts are told apart from the start, so
    # equal prefixes are of one text, and of those at most one ends with it.
    _, group, counts = np.unique(text_of.astype(np.int64) * (int(tokens.max()) + 1) + tokens, return_inverse=True, return_counts=True)
    ranks = [(np.cumsum(counts) - counts)[group].astype(np.int32)]  # by the first 1, 2, 4, ... tokens
    live, width = np.flatnonzero(counts[group] > 1), 1  # suffixes that others equal so far
    while len(live):
        rank = ranks[-1]
        after = live + width
        second = np.where(after < end_of[live], rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        first = rank[live].astype(np.int64)
        order = np.argsort(first * (n + 1) + second + 1)
        f, s = first[order], second[order]
        at = np.arange(len(order))
        head = np.r_[True, f[1:] != f[:-1]]
        new = head | np.r_[True, s[1:] != s[:-1]]
        start, run = np.maximum.accumulate(np.where(head, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank = rank.copy()
        rank[live[order]] = (f + run - start).astype(np.int32)
        ranks.append(rank)
        width *= 2
        live = live[order[~(new & np.r_[new[1:], True])]]
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1]] = np.arange(n)
    # The common prefix of neighbours, by the powers of two that it is the sum of.
    a, b = suffixes[:-1], suffixes[1:]
    same = np.flatnonzero(ranks[0][a] == ranks[0][b])
    a, b = a[same], b[same]
    got = np.zeros(len(same), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        x, y = a + got, b + got
        past = np.maximum(x, y) >= n
        x[past], y[past] = 0, 1
        got += ((ranks[level][x] == ranks[level][y]) & ~past).astype(np.int64) << level
    lcp = np.zeros(n + 1, np.int32)
    lcp[same + 1] = got
    out = np.empty(n, np.int32)
    out[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return out


def covered(spans: np.ndarray, least: int) -> np.ndarray:
    """Which tokens the union of the spans of at least ``least`` tokens holds."""
    n = len(spans)
    at = np.flatnonzero(spans >= least)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + spans[at], minlength=n + 1)
    return np.cumsum(edge[:-1]) > 0


_OUTPUT = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "longest_repeat": "long", "covered_chars": "long", "base_failed": "boolean", "kept": "boolean"}


def measure(texts: list[bytes], min_words: int, max_covered_percent: int, max_longest: int) -> list[tuple]:
    """The values of _OUTPUT for each text, in UTF-8."""
    words = [t.split() for t in texts]  # bytes.split() cuts at the six ASCII white characters only
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    number: dict[bytes, int] = {}
    tokens = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    # code points: bytes that do not continue another
    sizes = {w: len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in number}
    by_number = np.fromiter(sizes.values(), np.int64, len(sizes))
    chars = by_number[tokens] if len(tokens) else np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(len(words)), counts)
    spans = lcp_spans(tokens, text_of)
    in_window, in_long = covered(spans, WINDOW), covered(spans, min_words)
    stops = np.r_[0, np.cumsum(counts)]
    sums = lambda x: np.diff(np.r_[0, np.cumsum(x)][stops])
    word_chars, repeated, cover = sums(chars), sums(in_window.astype(np.int64)), sums(np.where(in_long, chars, 0))
    out = []
    for i, t in enumerate(texts):
        n = int(counts[i])
        longest = int(spans[stops[i]:stops[i + 1]].max()) if n else 0
        symbols = len(t) - len(t.translate(None, _SYMBOLS))
        lines = [x for x in t.split(b"\n") if x.strip()]
        failed = n < MIN_WORDS or 100 * int(repeated[i]) > MAX_REPEATED_PERCENT * n
        kept = not failed and 100 * int(cover[i]) <= max_covered_percent * int(word_chars[i]) and longest <= max_longest
        out.append((n, int(word_chars[i]), symbols, len(lines) - len(set(lines)), int(repeated[i]), longest, int(cover[i]), failed, kept))
    return out


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 5, max_covered_percent: int = 40, max_longest: int = 60) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, longest_repeat,
    covered_chars, base_failed and kept.

    A text is kept if it passes the base rules, if at most ``max_covered_percent`` of its word characters lie in
    repeats of ``min_words`` words or more, and if no repeat is longer than ``max_longest`` words. A null or empty
    text has no words and fails the base rules. Repeated rows stay; columns named as an output column are replaced; an empty table
    gives an empty one. No row needs another, so nothing is shuffled; a text is sorted in one task, in memory of
    about 100 bytes a word.
    """
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c not in _OUTPUT and c != text_col]
    rows = docs.select(packed(kept), column(text_col).cast("string").alias("text"))
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, texts in text_blocks(batch.column(1)):
                found = measure([t.encode() for t in texts], min_words, max_covered_percent, max_longest)
                columns = [pa.array(c, kinds[k]) for c, k in zip(zip(*found, strict=True), _OUTPUT.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(s.start, len(found)).columns, *columns], names=["row", "text", *_OUTPUT])

    found = rows.mapInArrow(run, schema_with(rows, ["row", "text"], _OUTPUT))
    return found.select(*unpacked(kept), F.col("text").alias(text_col), *_OUTPUT)
