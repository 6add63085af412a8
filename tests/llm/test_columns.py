"""Tables that also have every name that an operator uses inside: values come back unchanged, results are the same."""

import ast
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import rillwork.llm
from rillwork.llm import bpe, line_dedup, phrase_index, quality_cnn, repetition, shards, simhash, token_store, url_filter
from rillwork.llm.common import materialize

from .test_pipeline import folder  # noqa: F401


def names_of(*modules):
    """All texts in the code of these modules that could be a column's name, and some odd ones."""
    out = {"a.b", "with space", "__w"}
    for m in modules:
        for node in ast.walk(ast.parse(Path(m.__file__).read_text())):
            if isinstance(node, ast.Constant) and isinstance(node.value, str):
                out |= {w for w in re.findall(r"[A-Za-z_]\w{0,15}", node.value)} if len(node.value) < 120 else set()
    return sorted(out, key=str.lower)


def widened(df, modules, taken):
    """With all those names, but for ones that differ from another only by case or are taken."""
    seen = {c.lower() for c in taken}
    extra = [c for c in names_of(rillwork.llm.common, *modules) if not (c.lower() in seen or seen.add(c.lower()))]
    quoted = ["`" + c.replace("`", "``") + "`" for c in extra]
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(extra)]), extra, quoted


def plain(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


MODEL = quality_cnn.Model(quality_cnn.np.ones((4, 256, 16), "float32"), quality_cnn.np.zeros(16, "float32"), quality_cnn.np.ones(32, "float32") / 99, -1.0)
OPERATORS = {
    "op1": ([repetition], lambda d: repetition.quality_rules(d), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat", "covered_chars", "base_failed", "kept"]),
    "op5": ([bpe], lambda d: bpe.encode(d, *VOCABULARY(), ids_col="ids", decoded_col="again"), ["ids", "again"]),
    "op6": ([simhash, rillwork.llm.components], lambda d: simhash.near_duplicates(d), ["fingerprint", "component_id"]),
    "op7": ([shards], lambda d: shards.shard(d, 4), ["shard", "slot"]),
    "op8": ([line_dedup], lambda d: line_dedup.line_dedup(d, min_docs=2), ["n_lines", "n_dropped", "kept_text"]),
    "op8_joined": ([line_dedup], lambda d: line_dedup.line_dedup(d, min_docs=2, broadcast_bytes=0, keep_first_by="doc_id"), ["n_lines", "n_dropped", "kept_text"]),
    "op10": ([quality_cnn], lambda d: quality_cnn.score(d, MODEL), ["score"]),
}


def VOCABULARY():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    modules, run, made = OPERATORS[name]
    wide, extra, quoted = widened(docs, modules, [*docs.columns, *made])
    found = materialize(run(wide).drop("text"))
    assert set(extra) <= set(found.columns)
    assert found.count() == docs.count() and found.where(" or ".join(f"not {q} <=> {k}" for k, q in enumerate(quoted))).count() == 0
    if name != "op7":  # where rows lie decides there
        assert plain(found, ["doc_id", *made]) == plain(run(docs), ["doc_id", *made])


def test_url_filter(spark):
    pages = spark.createDataFrame([(0, "http://a.net/x"), (1, None)], "page_id long, url string")
    wide, extra, quoted = widened(pages, [url_filter], [*pages.columns, "host", "path", "rule", "verdict"])
    found = materialize(url_filter.url_verdicts(wide, url_filter.fixed_rules(spark, [("net", "/", "block")])))
    assert set(extra) <= set(found.columns) and found.where(" or ".join(f"not {q} <=> {k}" for k, q in enumerate(quoted))).count() == 0
    assert plain(found, ["page_id", "verdict"]) == [(0, "block"), (1, "allow")]


def test_tables_of_which_only_id_and_text_are_used(spark, docs, tmp_path):
    """The index, the classifier's sample and the token store."""
    items = spark.createDataFrame([(0, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "n_near_items"]
    wide = widened(docs, [phrase_index], docs.columns)[0]
    assert plain(phrase_index.contamination(wide, widened(items, [phrase_index], items.columns)[0], slop=2), columns) == plain(phrase_index.contamination(docs, items, slop=2), columns)
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")
    assert quality_cnn.sample(widened(docs, [quality_cnn], docs.columns)[0], widened(labels, [quality_cnn], labels.columns)[0]) == quality_cnn.sample(docs, labels)
    token_store.write(widened(docs, [token_store], docs.columns)[0], f"file://{tmp_path}/store", VOCABULARY()[0], 2)
    assert token_store.read(spark, f"file://{tmp_path}/store").count() == docs.count()


def test_stages(spark, folder):  # noqa: F811
    base, _ = folder
    docs = spark.read.parquet(f"{base}/documents.parquet")
    wide, extra, quoted = widened(docs, [corpus_pipeline, phrase_index, line_dedup, quality_cnn, rillwork.llm.jaccard], docs.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, wide = materialize(stage(spark, docs, base)), materialize(stage(spark, wide, base))
        assert wide.columns == [*docs.columns, *extra]
        assert plain(wide, docs.columns) == plain(docs, docs.columns)
        assert wide.where(" or ".join(f"not {q} <=> {k}" for k, q in enumerate(quoted))).count() == 0
    last = corpus_pipeline.STAGES[-1][1]
    assert plain(last(spark, wide, base), ["doc_id", "n_tokens", "decoded_sha256"]) == plain(last(spark, docs, base), ["doc_id", "n_tokens", "decoded_sha256"])
