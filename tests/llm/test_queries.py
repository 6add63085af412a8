import duckdb
import pytest

from rillwork.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())


def test_shards_of_documents(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op7_shards"](spark, SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    sizes = [sum(r["shard"] == k for r in got) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


DOCS, LONG, TEXT, FLAG = ("doc_id", "bigint"), "bigint", "string", "boolean"
#: Columns and types that the contracts fix.
CONTRACT = {
    "op1_repetition": [DOCS, ("n_words", LONG), ("word_chars", LONG), ("n_symbols", LONG), ("n_dup_lines", LONG), ("n_repeat_words", LONG), ("base_failed", FLAG), ("kept", FLAG)],
    "op2_decontamination": [DOCS, ("n_words", LONG), ("n_hit", LONG), ("n_items", LONG), ("items_sha256", TEXT), ("contaminated", FLAG)],
    "op3_chat_log": [("conv_id", LONG), ("n_turns", LONG), ("turns_sha256", TEXT), ("loss_chars", LONG), ("loss_sha256", TEXT), ("formatted_chars", LONG)],
    "op4_token_store": [DOCS, ("start", LONG), ("n_tokens", LONG), ("ids_crc32", LONG)],
    "op5_bpe": [DOCS, ("n_tokens", LONG), ("ids_sha256", TEXT), ("decoded_sha256", TEXT)],
    "op6_simhash": [DOCS, ("fingerprint", TEXT), ("component_id", LONG)],
    "op7_shards": [DOCS, ("size", LONG), ("text_crc32", LONG), ("law", TEXT), ("shard", "int"), ("slot", LONG), ("grown_shard", "int")],
    "op8_line_dedup": [DOCS, ("n_lines", LONG), ("n_dropped", LONG), ("kept_sha256", TEXT)],
    "op9_url_filter": [("page_id", LONG), ("host", TEXT), ("path", TEXT), ("rule", TEXT), ("verdict", TEXT)],
    "op10_quality_cnn": [DOCS, ("held_out", FLAG), ("score", "double"), ("predicted", "int")],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_types(spark, name):
    types = dict(QUERIES[name](spark, SMALL).dtypes)
    assert {c: types.get(c) for c, _ in CONTRACT[name]} == dict(CONTRACT[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_tokens_of_documents(spark, texts, tokenizer):
    import hashlib
    import zlib
    from array import array

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer[0])
    t.no_truncation()
    t.no_padding()
    ids = {i: t.encode(x, add_special_tokens=False).ids for i, x in texts.items()}
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op5_bpe"](spark, SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {i: (len(x), sha(array("I", x).tobytes()), sha(t.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()}
    start, want = 0, {}
    for i in sorted(ids):
        own = [*ids[i], 2]
        want[i] = start, len(own), zlib.crc32(array("I", own).tobytes())
        start += len(own)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op4_token_store"](spark, SMALL).collect()} == want


def test_groups_of_documents(spark, texts):
    from .test_simhash import fingerprint, groups

    points = [(i, fingerprint(t)) for i, t in texts.items()]
    want = sorted((i, f"{f:016x}", g) for (i, f), g in zip(points, groups(points, 4), strict=True))
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, SMALL).collect()) == want


def test_scores_of_documents(spark, texts):
    import zlib

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_cnn"](spark, SMALL).collect()}
    assert set(got) == set(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held
    right = [got[i]["predicted"] == y for i, y in labels.items() if i in got]
    assert sum(right) >= 0.9 * len(right)
