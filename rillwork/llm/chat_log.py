"""Chat formatting from event logs.

A log has, for each conversation, events in sequence: a message starts, grows by streamed deltas,
is edited, regenerated or deleted. The fold gives final messages; the template renders each as a piece of its
conversation with a loss mask; control strings inside texts are escaped, and what is rendered can be read back.

A conversation's formatted text is its pieces in order. They stay rows, so a conversation of any length is folded and
rendered by many tasks. Only a digest over a whole conversation is taken in order by one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import schema_with, ship_code

#: The template's marks, and other templates' control strings, that no text may hold unescaped.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROL = [OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]

EVENTS = "conv_id bigint, msg bigint, turn bigint, seq bigint, kind string, role string, text string"
#: Kinds: start (with role), delta (text to add), edit (text that replaces), regenerate (begin again; later turns begun before are dropped), delete.
_RESETS = ("start", "edit", "regenerate")
_FIRST_TURN, _TURNS = -(1 << 62), 1024


def _pattern() -> str:
    return "([" + re.escape("".join(sorted({c[0] for c in CONTROL}))) + r"])(\\*)(" + "|".join(sorted({re.escape(c[1:]) for c in CONTROL}, key=len, reverse=True)) + ")"


def escape(c: Column) -> Column:
    """A control string gets a backslash after its first character, one more if it has some there already."""
    return F.regexp_replace(c, _pattern(), r"$1\\$2$3")


_ESCAPED = re.compile(_pattern().replace(r"(\\*)", r"\\(\\*)"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def _role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\l")))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, msg, turn, role, text): the final messages of a log with the columns of EVENTS, of which conv_id and msg may also be of other types.

    A message is a conv_id and msg. Its text is what the last start, edit or regenerate set and the deltas from then on, by seq; its role and turn are the last
    non-null ones. Of events with equal seq, starts and regenerations count as first, then edits, of which the greatest text
    stays, then deltas, by their text, and a delete as last; of equal seq the greatest role and turn stay. A deleted message is gone unless it starts again. A regenerate at a turn drops the messages of later turns whose first
    event came before it. A null turn comes first; null conv_id or msg are values like others; null texts are empty; a message without a role has an empty one.
    Events with a null seq come first. Repeated events act again, as logged. Other columns are ignored; an empty log has no messages.
    """
    seq = F.coalesce(F.col("seq"), F.lit(_FIRST_TURN))
    e = events.select("conv_id", "msg", "turn", seq.alias("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    own = Window.partitionBy("conv_id", "msg")
    e = e.withColumns({
        "_reset": F.max(F.when(F.col("kind").isin(*_RESETS), F.col("seq"))).over(own),
        "_gone": F.max(F.when(F.col("kind") == "delete", F.col("seq"))).over(own),
        "_first": F.min("seq").over(own),
    }).where(F.col("_gone").isNull() | (F.col("_reset") > F.col("_gone")))
    last = lambda c, when: F.max(F.when(when, F.struct("seq", c)))
    adds = (F.col("kind") == "delta") & (F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset")))
    base = F.when(F.col("_edit.seq") == F.col("_set"), F.col("_edit.text")).otherwise(F.lit(""))
    made = e.groupBy("conv_id", "msg").agg(
        last("turn", F.col("turn").isNotNull())["turn"].alias("turn"),
        F.coalesce(last("role", F.col("role").isNotNull())["role"], F.lit("")).alias("role"),
        last("text", F.col("kind") == "edit").alias("_edit"),
        F.max("_reset").alias("_set"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(adds, F.struct("seq", "text")))), lambda x: x["text"]), "").alias("_added"),
        F.min("_first").alias("_first"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_cut"),
    ).withColumn("text", F.concat(base, "_added")).drop("_edit", "_set", "_added")
    at = F.coalesce("turn", F.lit(_FIRST_TURN))
    made = made.withColumns({"_at": at, "_block": F.floor(at / _TURNS)})
    # The last regeneration at an earlier turn: of earlier blocks of turns, and within the block. So no task has to hold a conversation.
    ahead = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    block = made.groupBy(F.col("conv_id").alias("_c"), F.col("_block").alias("_b")).agg(F.max("_cut").alias("_m"))
    block = block.withColumn("_before", F.max("_m").over(ahead)).where(F.col("_before").isNotNull()).drop("_m")
    inside = Window.partitionBy("conv_id", "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("_here", F.max("_cut").over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b"))
    made = made.join(block, same, "left")
    late = F.greatest("_here", "_before")  # null only if both are
    return made.where(late.isNull() | (F.col("_first") > late)).select("conv_id", "msg", "turn", "role", "text")


def render(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``messages`` (conv_id, msg, turn, role, text) with the piece of the formatted conversation, and the loss mask in it as (loss_start, loss_length) in code points.

    Pieces follow one another by turn (null first), role, text and msg; the mask is empty but for the trained role, where it covers the escaped text alone.
    """
    head = F.concat(F.lit(OPEN), _role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    mine = F.col("role") == trained_role
    return messages.withColumns({
        "piece": F.concat(head, body, F.lit(CLOSE + "\n")),
        "loss_start": F.length(head).cast("long"),
        "loss_length": F.when(mine, F.length(body)).otherwise(0).cast("long"),
    })


def read_piece(piece: str) -> tuple[str, str]:
    """Role and text of a rendered piece."""
    if not (piece.startswith(OPEN) and piece.endswith(CLOSE + "\n")):
        raise ValueError("not a piece of a formatted conversation")
    role, _, text = piece[len(OPEN):-len(CLOSE) - 1].partition("\n")
    return unescape(role).replace("\\l", "\n").replace("\\b", "\\"), unescape(text)


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    ship_code(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kind = None, None, None

        def done() -> pa.RecordBatch:
            n, turns, chars, loss, size = state
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([at[0]], kind), "n_turns": [n], "turns_sha256": [turns.hexdigest()],
                                               "loss_chars": [chars], "loss_sha256": [loss.hexdigest()], "formatted_chars": [size]})

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, piece, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (conv,):
                    if at:
                        yield done()
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_piece(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(piece[start:start + length])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
        if at:
            yield done()

    order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "msg")
    outputs = {"n_turns": "long", "turns_sha256": "string", "loss_chars": "long", "loss_sha256": "string", "formatted_chars": "long"}
    return order.select("conv_id", "piece", "loss_start", "loss_length").mapInArrow(run, schema_with(pieces, ["conv_id"], outputs))


def events_of(rows: DataFrame) -> DataFrame:
    """A log that folds into ``rows`` (conv_id, turn, role, text): each row is a message, streamed in two halves;
    trained answers are regenerated once, other messages edited into their final text."""
    text, turn = F.coalesce("text", F.lit("")), F.col("turn")
    base = F.coalesce(turn * 8, F.lit(_FIRST_TURN))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    role = F.coalesce("role", F.lit(""))

    def event(k: int, kind: str, what: Column | None = None) -> Column:
        return F.struct((base + k).alias("seq"), F.lit(kind).alias("kind"), (role if kind == "start" else F.lit(None).cast("string")).alias("role"),
                        (F.lit(None).cast("string") if what is None else what).alias("text"))

    answered = F.array(event(0, "start"), event(1, "delta", first), event(2, "regenerate"), event(3, "delta", first), event(4, "delta", second))
    edited = F.array(event(0, "start"), event(1, "delta", first), event(2, "edit", text))
    log = rows.select("conv_id", F.monotonically_increasing_id().alias("msg"), "turn", F.when(role == "assistant", answered).otherwise(edited).alias("_e"))
    return log.select("conv_id", "msg", "turn", F.explode("_e").alias("_x")).select("conv_id", "msg", "turn", "_x.*")
