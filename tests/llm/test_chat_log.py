import hashlib
import random

from pyspark.sql import functions as F

from rillwork.llm import chat_log


def test_fold(spark, rows):
    log = [
        (1, 0, 0, 1, "start", "user", None), (1, 0, 0, 2, "delta", None, "Hel"), (1, 0, 0, 3, "delta", None, "lo"),
        (1, 1, 1, 4, "start", "assistant", None), (1, 1, 1, 5, "delta", None, "bad"), (1, 1, 1, 9, "regenerate", None, None), (1, 1, 1, 10, "delta", None, "good"), (1, 1, 1, 11, "delta", None, None),
        (1, 2, 2, 6, "start", "user", None), (1, 2, 2, 7, "delta", None, "dropped by the regeneration"),
        (1, 3, 2, 12, "start", "user", None), (1, 3, 2, 13, "edit", None, "edited"), (1, 3, 2, 14, "delta", None, "!"),
        (1, 4, 3, 15, "start", "user", None), (1, 4, 3, 16, "delete", None, None),
        (1, 5, 4, 17, "delete", None, None), (1, 5, 4, 18, "start", "user", None), (1, 5, 4, 19, "delta", None, "back"),
        (2, 0, None, 1, "delta", None, "no start"), (None, 0, 0, 1, "start", "system", None), (2, 1, 5000, 2, "start", "user", "x"),
    ]
    events = spark.createDataFrame(log, chat_log.EVENTS).repartition(4)
    got = rows(chat_log.fold(events.withColumn("extra", F.lit(1))))
    assert got == sorted([(1, 0, 0, "user", "Hello"), (1, 1, 1, "assistant", "good"), (1, 3, 2, "user", "edited!"), (1, 5, 4, "user", "back"),
                          (2, 0, None, "", "no start"), (None, 0, 0, "system", ""), (2, 1, 5000, "user", "")], key=repr)
    assert chat_log.fold(events.where("false")).count() == 0


def test_ties_and_other_types_of_ids(spark, rows):
    log = [
        ("a", "x", 0, 1, "delta", None, "2"), ("a", "x", 0, 1, "delta", None, "1"), ("a", "x", 0, 1, "edit", None, "E"), ("a", "x", 0, 1, "edit", None, "D"), ("a", "x", 0, 1, "start", "user", None), ("a", "x", 1, 1, "regenerate", "tool", None),
        ("a", "y", 0, 5, "delete", None, None), ("a", "y", 0, 5, "start", "user", None),
        (None, "z", 0, 2, "start", "user", None), (None, "z", 0, 2, "delta", None, "n"), ("0", "z", 0, None, "delta", None, "first"), ("0", "z", 0, 0, "delta", None, " then"),
        ("c", "m", 0, 1, "start", "user", None), ("c", "n", 3000, 2, "start", "user", None), ("c", "m", 0, 3, "regenerate", None, None),
    ]
    events = spark.createDataFrame(log, chat_log.EVENTS.replace("conv_id bigint, msg bigint", "conv_id string, msg string"))
    want = sorted([("a", "x", 1, "user", "E12"), (None, "z", 0, "user", "n"), ("0", "z", 0, "", "first then"), ("c", "m", 0, "user", "")], key=repr)
    for parts in (1, 4):
        assert rows(chat_log.fold(events.repartition(parts))) == want
    found = chat_log.digests(chat_log.render(chat_log.fold(events)))
    assert dict(found.dtypes)["conv_id"] == "string" and sorted(r["conv_id"] or "" for r in found.collect()) == ["", "0", "a", "c"]


def test_regeneration_reaches_over_blocks_of_turns(spark, rows):
    log = [(1, m, m * 700, m, "start", "user", None) for m in range(5)] + [(1, 1, 700, 3, "regenerate", None, None)]
    got = rows(chat_log.fold(spark.createDataFrame(log, chat_log.EVENTS)).select("msg"))
    assert got == [(0,), (1,), (4,)]  # turns 1400 and 2100 began at 2 and 3, not after 3


def test_escapes_are_reversible_and_leave_no_control_string(spark):
    rng = random.Random(2)
    parts = [*chat_log.CONTROL, "<", "\\", "|", "[", "s>", "/s>", "INST]", "x", "\n", "é", "\\b", "\\l", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(1500)]
    df = spark.createDataFrame([(i, i, 0, "assistant" if i % 3 else t, t) for i, t in enumerate(texts)], "conv_id long, msg long, turn long, role string, text string")
    for r in chat_log.render(df).collect():
        assert chat_log.read_piece(r["piece"]) == (r["role"], r["text"])
        inner = r["piece"][len(chat_log.OPEN):-len(chat_log.CLOSE) - 1]
        assert not any(c in inner for c in chat_log.CONTROL)
        masked = r["piece"][r["loss_start"]:r["loss_start"] + r["loss_length"]]
        assert chat_log.unescape(masked) == (r["text"] if r["role"] == "assistant" else "")


def test_digests(spark, picked):
    rows = [(1, 1, "assistant", "B <s>"), (1, 0, "user", "A"), (1, 2, None, None), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (1, 1, "assistant", "B <s>"), (3, None, "assistant", "first"), (3, 0, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = chat_log.digests(chat_log.render(chat_log.fold(chat_log.events_of(df))))
    want = []
    for c in (1, 2, 3, None):
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        want.append((c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert picked(found, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == sorted(want, key=repr)
    assert chat_log.digests(chat_log.render(chat_log.fold(chat_log.events_of(df.where("false"))))).count() == 0
