"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for each document shard, the postings (term, document row, position) sorted by
term, so a term's list is read without the others. A phrase is looked up from its rarest term: the
list gives starts, the second rarest term's list, shifted by the offset, is intersected with them,
and what is left meets the other terms. Proximity search does the same with a tolerance; exact matches are then those of its
matches where every term stands in its very place.
Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, column, materialize, small

#: What separates words: ASCII but digits and small letters (text is lower-cased first).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The entry that every document has: no word is a space.
_MARK, _MARK_ID = " ", -1


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The different windows of the items' texts as (wid, words), and (wid, item): ``size`` consecutive words,
    or all words of an item that has fewer, but some."""
    w = items.select(column(id_col).cast("string").alias("item"), words(column(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))
    each = w.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(size)).alias("words")).distinct()
    phrases = materialize(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return phrases, materialize(each.join(small(phrases), "words").select("wid", "item"))


class PositionalIndex:
    """Postings of the terms of ``vocabulary`` (all terms if None) in the documents.

    ``rows`` has a row for each document: _row, the id column's value as _id, n_words. ``postings`` has tid, _row and
    pos (from 1), sorted by term in each file. ``vocab`` has term and tid.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame | None, id_col: str = "doc_id", text_col: str = "text"):
        split = docs.select(F.monotonically_increasing_id().alias("_row"), column(id_col).alias("_id"), words(column(text_col)).alias("_w"))
        split = split.select("_row", "_id", F.size("_w").cast("long").alias("n_words"), F.concat(F.array(F.lit(_MARK)), "_w").alias("_w"))
        terms = split.select("_row", "_id", "n_words", F.posexplode("_w").alias("pos", "term"))
        if vocabulary is None:
            vocabulary = terms.where(F.col("term") != _MARK).select("term").distinct()
        self.vocab = materialize(vocabulary.select("term").distinct().select("term", F.monotonically_increasing_id().alias("tid")))
        mark = docs.sparkSession.range(1).select(F.lit(_MARK).alias("term"), F.lit(_MARK_ID).cast("long").alias("tid"))
        known = small(self.vocab.unionByName(mark))
        is_mark = F.col("tid") == _MARK_ID
        entries = terms.join(known, "term").select("tid", "_row", "pos", F.when(is_mark, F.col("_id")).alias("_id"), F.when(is_mark, F.col("n_words")).alias("n_words"))
        stored = materialize(entries.sortWithinPartitions("tid", "_row", "pos"), **{"parquet.block.size": str(16 << 20), "compression": "zstd"})
        self.rows = stored.where(is_mark).select("_row", "_id", "n_words")
        self.postings = stored.where(F.col("tid") >= 0).select("tid", "_row", "pos")

    def ranked(self, phrases: DataFrame) -> DataFrame:
        """(wid, off, tid, len, r): each phrase's terms, r = 1 for the rarest; phrases with a term that no document has are left out."""
        counts = self.postings.groupBy("tid").agg(F.count("*").alias("n"))
        terms = phrases.select("wid", F.size("words").alias("len"), F.posexplode("words").alias("off", "term"))
        known = terms.join(small(self.vocab), "term").join(counts, "tid")
        by = Window.partitionBy("wid")
        known = known.withColumn("_have", F.count("*").over(by)).where(F.col("_have") == F.col("len"))
        return materialize(known.select("wid", "off", "tid", "len", F.row_number().over(by.orderBy("n", "off")).alias("r")))

    def starts(self, terms: DataFrame) -> DataFrame:
        """Where the rarest term of each phrase puts its start: (_row, wid, start, len). Starts before the document's first word are there too."""
        rarest = small(materialize(terms.where("r = 1").select("tid", "wid", "off", "len")))
        return self.postings.join(rarest, "tid").select("_row", "wid", (F.col("pos") - F.col("off")).alias("start"), "len")

    def _met(self, found: DataFrame, others: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
        """(_row, wid, start, len, _off): the terms of ``others`` that ``lists`` has at most ``slop`` words from their places in a match found so far."""
        asked = found.join(small(materialize(others)), "wid").withColumn("_at", F.col("start") + F.col("_off"))
        if not slop:
            on = (asked["_row"] == lists["_row"]) & (F.col("_at") == F.col("pos")) & (F.col("_tid") == F.col("tid"))
            return asked.join(lists, on, "left_semi").select("_row", "wid", "start", "len", "_off")
        wide = max(32, 2 * slop + 1)  # a place and its surroundings lie in one cell of positions, or two
        low, high = F.floor((F.col("_at") - slop) / wide), F.floor((F.col("_at") + slop) / wide)
        asked = asked.withColumn("_cell", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))))
        lists = lists.withColumn("_c", F.floor(F.col("pos") / wide))
        on = (asked["_row"] == lists["_row"]) & (F.col("_tid") == F.col("tid")) & (F.col("_cell") == F.col("_c")) & (F.abs(F.col("pos") - F.col("_at")) <= slop)
        return asked.join(lists, on, "left_semi").select("_row", "wid", "start", "len", "_off").distinct()

    def _full(self, found: DataFrame, others: DataFrame, slop: int, fewer: int) -> DataFrame:
        """The matches of which all but ``fewer`` terms are met by ``others``."""
        near = self.postings.join(small(materialize(found.select("_row").distinct())), "_row", "left_semi")
        met = self._met(found.where(F.col("len") > fewer), others, near, slop)
        return met.groupBy("_row", "wid", "start", "len").agg(F.count("*").alias("_n")).where(F.col("_n") == F.col("len") - fewer).drop("_n")

    def near(self, phrases: DataFrame, slop: int) -> DataFrame:
        """Proximity matches of the phrases (wid, words): (_row, wid, start, len).

        A phrase's anchor is its term that the documents hold least often, the first of these in the phrase. Each occurrence of the anchor is a match
        if every other word of the phrase stands at most ``slop`` words from its place beside the anchor, on either side and in any order. ``start`` is
        where the phrase would begin; it may lie before the document's first word (which has number 1).
        """
        return self._near(self.ranked(phrases), slop)

    def _near(self, terms: DataFrame, slop: int) -> DataFrame:
        found = self.starts(terms)
        if not slop:
            found = found.where("start >= 1")
        other = lambda which: terms.where(which).select("wid", F.col("off").alias("_off"), F.col("tid").alias("_tid"))
        second = other("r = 2")
        lists = self.postings.join(small(materialize(second.select(F.col("_tid").alias("tid")).distinct())), "tid", "left_semi")
        two = self._met(found.where("len > 1"), second, lists, slop)
        left = materialize(found.where("len = 1").unionByName(two.drop("_off")))
        return left.where("len <= 2").unionByName(self._full(left.where("len > 2"), other("r > 2"), slop, 2))

    def exact(self, phrases: DataFrame) -> DataFrame:
        """All occurrences of the phrases (wid, words): (_row, wid, start, len), start from 1."""
        return self._near(self.ranked(phrases), 0)

    def both(self, phrases: DataFrame, slop: int) -> tuple[DataFrame, DataFrame]:
        """Proximity matches as ``near`` gives them, and among them the exact ones; one search for both."""
        terms = self.ranked(phrases)
        found = materialize(self._near(terms, slop))
        others = terms.where("r > 1").select("wid", F.col("off").alias("_off"), F.col("tid").alias("_tid"))
        inside = found.where("start >= 1")
        return found, inside.where("len = 1").unionByName(self._full(inside.where("len > 1"), others, 0, 1))

    @staticmethod
    def n_covered(matches: DataFrame) -> DataFrame:
        """(_row, n_hit): words inside any match, from the matches' spans in order, without listing positions."""
        spans = matches.groupBy("_row", "start").agg(F.max("len").alias("len"))
        order = Window.partitionBy("_row").orderBy("start")
        end = F.col("start") + F.col("len") - 1
        before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = F.greatest(F.lit(0), end - F.greatest(before, F.col("start") - 1))
        return spans.withColumn("_new", new).groupBy("_row").agg(F.sum("_new").cast("long").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, size: int = 8, min_items: int = 2, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", slop: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: the id column, n_words, n_hit, n_items, items (sorted strings), spans (start and len, in words from 1) and contaminated.

    With ``slop`` also n_near_items: the items with a window that has a proximity match (see ``PositionalIndex.near``).
    Null texts have no words; null or empty items match nothing. Repeated rows each get a row. With no items or no documents nothing
    is hit. Documents keep one row each, whatever their other columns are called.
    """
    phrases, of = windows(items, size, item_col, text_col)
    index = PositionalIndex(docs, phrases.select(F.explode("words").alias("term")).distinct(), id_col, text_col)
    near = None
    if slop:
        near, found = index.both(phrases, slop)
    else:
        found = index.exact(phrases)
    found, of = materialize(found), small(of)
    pairs = found.select("_row", "wid").distinct().join(of, "wid").select("_row", "item").distinct()
    per_doc = pairs.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    spans = found.select("_row", F.struct("start", "len").alias("_s")).groupBy("_row").agg(F.collect_set("_s").alias("spans"))
    out = index.rows.join(index.n_covered(found), "_row", "left").join(per_doc, "_row", "left").join(spans, "_row", "left")
    items_found = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    columns = [F.col("_id").alias(id_col), "n_words", F.coalesce(F.col("n_hit"), F.lit(0)).cast("long").alias("n_hit"),
               F.size(items_found).cast("long").alias("n_items"), items_found.alias("items"), "spans", (F.size(items_found) >= min_items).alias("contaminated")]
    if near is not None:
        counts = near.select("_row", "wid").distinct().join(of, "wid").groupBy("_row").agg(F.count_distinct("item").alias("_near"))
        out = out.join(counts, "_row", "left")
        columns.append(F.coalesce("_near", F.lit(0)).cast("long").alias("n_near_items"))
    return out.select(*columns)


def without_spans(text: Column, spans: Column) -> Column:
    """``text`` without the words of the spans (as ``contamination`` gives them) and what separates each from the word before."""
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    parts = F.regexp_extract_all(text, F.lit(rf"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{word}+"), F.lit(0))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    inside = lambda i: F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["len"]))
    return F.concat(F.array_join(F.filter(parts, lambda _, i: ~inside(i)), ""), tail)
