import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = " ".join(f"word{i} the" for i in range(4000))
BASE = [
    (0, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),  # a copy
    (2, "", "en", "a"),
    (3, None, None, None),
    (4, LONG, "de", "b"),
    (5, "  \n\t\n\x0b  ", "en", "hot"),
    (6, "Ünïcode ÀÉ 中文 😀 text\nsecond line\nsecond line\n THE SECOND Line \t", "fr", "hot"),
    (None, "no id at all\nsecond line", "en", "hot"),
    (7, "again and again and again and again", "en", "hot"),
    (7, "again and again and again and again", "en", "hot"),  # a repeated row
    (8, "<|endoftext|> and </s>[INST] ok", "en", "c"),
    (9, "x" * 5000, "en", "c"),
]


@pytest.fixture()
def docs(spark):
    rows = [(i, t, a, b, None if t is None else len(t)) for i, t, a, b in BASE]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def by_id(found, *columns):
    """Rows as sorted tuples of these columns."""
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


@pytest.fixture()
def picked():
    return by_id
