"""The queries of this package: each applies one operator to a whole table and returns its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_log, line_dedup, phrase_index, quality_cnn, repetition, shards, simhash, token_store, url_filter
from .common import materialize, read, rows_frame, shared_dir


def vocabulary() -> tuple[str, str]:
    """Path of the tokenizer file and the pattern that cuts its pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return repetition.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_chars")


#: Words by which a word may be off its place in a proximity match.
NEAR_SLOP = 2


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_index.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), slop=NEAR_SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near_items")


def op3_chat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    more = rows_frame(spark, [(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id bigint,turn bigint,role string,text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    log = materialize(chat_log.events_of(rows))
    return chat_log.digests(materialize(chat_log.render(chat_log.fold(log))))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_store.write(read(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary()[0], end_id=2)
    return token_store.checksums(token_store.read(spark, path))


#: Parts of texts that op5's workers keep in a generation of their cache; other stages share its executors in the pipeline, which has the default.
BPE_PARTS = 400_000


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), *vocabulary(), parts=BPE_PARTS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, width=4, distance=4).select("doc_id", "fingerprint", "component_id")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shards.shard(rows, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs, min_docs=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Fixed by the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_verdicts(pages, url_filter.fixed_rules(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


#: Fixed by the contract: scores from here on are of label 1.
QUALITY_THRESHOLD = 0.3


def op10_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model)
    return scored.select("doc_id", quality_cnn.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": op1_repetition,
    "op2_decontamination": op2_decontamination,
    "op3_chat_log": op3_chat_log,
    "op4_token_store": op4_token_store,
    "op5_bpe": op5_bpe,
    "op6_simhash": op6_simhash,
    "op7_shards": op7_shards,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_quality_cnn": op10_quality_cnn,
}

ORACLE_SQL: dict[str, str] = {
    "op1_repetition": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM d),
ahead AS (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2, lead(word, 3) OVER o AS w3, lead(word, 4) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, i, n, length(word) AS c,
    CASE WHEN i + 2 <= n THEN count(*) OVER (PARTITION BY doc_id, word, w1, w2) ELSE 0 END AS n3,
    CASE WHEN i + 4 <= n THEN count(*) OVER (PARTITION BY doc_id, word, w1, w2, w3, w4) ELSE 0 END AS n5 FROM ahead),
long_ones AS (SELECT doc_id, hash(list_slice(w, i, i + 60)) AS h FROM grams JOIN d USING (doc_id) WHERE n5 > 1 AND i + 60 <= n GROUP BY ALL HAVING count(*) > 1),
held AS (SELECT doc_id, c,
    max(n3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS in3,
    max(n5) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 1 AS in5 FROM grams),
sums AS (SELECT doc_id, count(*) AS n_words, sum(c) AS word_chars, count(*) FILTER (in3) AS n_repeat_words, coalesce(sum(c) FILTER (in5), 0) AS covered_chars,
    doc_id IN (SELECT doc_id FROM long_ones) AS long FROM held GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
joined AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_chars, 0) AS covered_chars, coalesce(long, false) AS long
    FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN dups USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM joined)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(covered_chars AS BIGINT) AS covered_chars, base_failed,
    NOT base_failed AND 100 * covered_chars <= 40 * word_chars AND NOT long AS kept FROM judged""",
    "op2_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item_id, list_slice(w, i, i + 7) AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS n FROM wins),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins ON grams.g = wins.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
places AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS t FROM d),
often AS (SELECT t, count(*) AS n FROM places GROUP BY t),
numbered AS (SELECT g, row_number() OVER () AS wid FROM (SELECT DISTINCT g FROM wins)),
parts AS (SELECT wid, len(g) AS size, unnest(range(len(g))) AS off, unnest(g) AS t FROM numbered),
known AS (SELECT parts.*, count(*) OVER (PARTITION BY wid) AS have, row_number() OVER (PARTITION BY wid ORDER BY n, off) AS r FROM parts JOIN often USING (t)),
whole AS (SELECT * FROM known WHERE have = size),
anchors AS (SELECT wid, size, doc_id, p - off AS s FROM whole JOIN places USING (t) WHERE r = 1),
met AS (SELECT DISTINCT a.wid, a.size, a.doc_id, a.s, o.off FROM anchors a JOIN whole o ON a.wid = o.wid AND o.r > 1
  JOIN places w ON w.doc_id = a.doc_id AND w.t = o.t AND w.p BETWEEN a.s + o.off - 2 AND a.s + o.off + 2),
near AS (SELECT wid, doc_id FROM met GROUP BY wid, size, doc_id, s HAVING count(*) = size - 1 UNION SELECT wid, doc_id FROM anchors WHERE size = 1),
close_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN numbered USING (wid) JOIN wins USING (g) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated,
  coalesce(n_near, 0) AS n_near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN close_items USING (doc_id)""",
    "op3_chat_log": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, role, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>' || role || chr(10) || t || '<|im_end|>' || chr(10))
    + len(regexp_extract_all(t, '<\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)|\[\\*(?:INST\]|/INST\])'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op8_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (common.k IS NOT NULL) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.k = common.k GROUP BY doc_id""",
    "op9_url_filter": r"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (SELECT c.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM cut c LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM hit WHERE k = 1""",
}
