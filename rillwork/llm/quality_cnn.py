"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are cut into chunks that overlap by WIDTH - 1 bytes and cover all of it. Learned filters of WIDTH
bytes slide over each chunk; the greatest response of each filter in a chunk goes through a rectifier. The chunks' values are
combined, as their mean and their maximum over the document, into one probability by a logistic layer.

A filter's response is a sum of table entries, one for each of its bytes, so two bytes are looked up at once in a table of pairs.
Training (Adam on the log loss) is exact through the maxima: only the winning window of each filter gets a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, packed, schema_with, ship_code, unpacked
from .word_cache import text_blocks

WIDTH, FILTERS, CHUNK = 4, 16, 256
#: Bounds of the training sample, of whole rows: labelled rows, bytes of their texts together, and bytes of one text (rows of longer ones are no candidates).
MAX_ROWS, MAX_BYTES, MAX_TEXT = 2_000, 16 << 20, 2 << 20
STEPS, BATCH, RATE = 480, 50, 0.01


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS: of the mean, of the maximum
    offset: float

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables
        size = (1 << 16, FILTERS)
        return (t[0][:, None] + t[1][None]).reshape(size), (t[2][:, None] + t[3][None]).reshape(size)


def chunked(data: bytes) -> bytes:
    """Padded with zero bytes to whole chunks, with WIDTH - 1 zeros at least after the last byte."""
    return data + bytes(-(len(data) + WIDTH - 1) % CHUNK + WIDTH - 1)


def responses(flat: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The greatest response of each filter in each chunk of ``flat``, the padded texts in a row; ``ends`` is where each ends."""
    n = len(flat) // CHUNK
    pair = flat.astype(np.int32) << 8
    pair[:-1] |= flat[1:]
    ahead = np.zeros_like(pair)
    ahead[:-2] = pair[2:]
    # the last windows of a text reach past its padding: into zeros, not into the next text
    for k in range(1, WIDTH):
        ahead[ends - k] = 0
    pair[ends - 1] = 0
    best = np.empty((n, FILTERS), np.float32)
    step = 32
    a, b = np.empty((2, step * CHUNK, FILTERS), np.float32)
    for k in range(0, n, step):
        m = min(step, n - k)
        part = slice(k * CHUNK, (k + m) * CHUNK)
        size = m * CHUNK
        np.take(first, pair[part], axis=0, out=a[:size], mode="clip")
        np.take(second, ahead[part], axis=0, out=b[:size], mode="clip")
        np.add(a[:size], b[:size], out=a[:size])
        a[:size].reshape(m, CHUNK, FILTERS).max(axis=1, out=best[k:k + m])
    return best


def pooled(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean and the maximum over each document's chunks, side by side."""
    starts = np.cumsum(counts) - counts
    return np.hstack([np.add.reduceat(values, starts, axis=0) / counts[:, None], np.maximum.reduceat(values, starts, axis=0)]).astype(values.dtype)


def predict(model: Model, texts: list[bytes], tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    parts = [chunked(t) for t in texts]
    counts = np.array([len(p) // CHUNK for p in parts])
    best = responses(np.frombuffer(b"".join(parts), np.uint8), CHUNK * counts.cumsum(), *(tables or model.pairs()))
    x = pooled(np.maximum(best + model.bias, 0), counts)
    z = (x * model.weights).sum(axis=1, dtype=np.float64) + model.offset
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def windows_of(data: bytes) -> np.ndarray:
    """The chunks of a text, each with the WIDTH - 1 bytes after it."""
    flat = np.frombuffer(chunked(data) + bytes(CHUNK), np.uint8)
    n = len(flat) // CHUNK - 1
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK + WIDTH - 1), (CHUNK, 1))


def winners(docs: list[np.ndarray], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest response of each filter in each chunk of ``docs`` and the bytes of the window that gives it (chunk, filter, WIDTH).

    Only these are kept, so a document of any length takes little memory."""
    size = (1 << 16, FILTERS)
    first, second = (tables[0][:, None] + tables[1][None]).reshape(size), (tables[2][:, None] + tables[3][None]).reshape(size)
    n = sum(map(len, docs))
    best, held, at = np.empty((n, FILTERS), tables.dtype), np.empty((n, FILTERS, WIDTH), np.uint8), 0
    for doc in docs:
        for k in range(0, len(doc), 32):
            part = doc[k:k + 32]
            pair = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            got = first[pair[:, :CHUNK]] + second[pair[:, 2:CHUNK + 2]]
            where = got.argmax(axis=1)
            best[at:at + len(part)] = np.take_along_axis(got, where[:, None], axis=1)[:, 0]
            row = np.arange(len(part))[:, None]
            for w in range(WIDTH):
                held[at:at + len(part), :, w] = part[row, where + w]
            at += len(part)
    return best, held


def gradients(params: list[np.ndarray], docs: list[np.ndarray], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean log loss over ``docs`` (as ``windows_of`` gives them) and its gradient for tables, bias, weights and offset."""
    tables, bias, weights, offset = params
    counts = np.array([len(d) for d in docs])
    best, held = winners(docs, tables)
    value = np.maximum(best + bias, 0)
    starts = np.cumsum(counts) - counts
    x = pooled(value, counts)
    z = np.clip(x @ weights + offset[0], -40, 40)
    dz = (1 / (1 + np.exp(-z)) - labels) / len(docs)
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    dx = dz[:, None] * weights[None]
    of = np.repeat(np.arange(len(docs)), counts)
    dv = dx[of, :FILTERS] / counts[of][:, None]
    top = (value == x[of, FILTERS:]) & (value > 0)
    ties = np.add.reduceat(top.astype(tables.dtype), starts, axis=0)
    dv += np.where(top, dx[of, FILTERS:] / np.maximum(ties, 1)[of], 0)
    dv = np.where(value > 0, dv, 0).astype(tables.dtype)
    grads = [np.zeros_like(tables), dv.sum(axis=0), x.T @ dz, np.array([dz.sum()], tables.dtype)]
    f = np.broadcast_to(np.arange(FILTERS), dv.shape)
    for w in range(WIDTH):
        np.add.at(grads[0][w], (held[:, :, w], f), dv)
    return loss, grads


def train(rows: list[tuple[bytes, int]], seed: int = 5) -> Model:
    """``rows``: whole texts in UTF-8 and their labels."""
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    labels = np.array([y for _, y in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(rows) else 0.5
        return Model(model.tables * 0, model.bias, model.weights * 0, float(np.log(share / (1 - share))))
    params = [model.tables, model.bias, model.weights, np.array([np.log(labels.mean() / (1 - labels.mean()))], np.float32)]
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    docs = [windows_of(t) for t, _ in rows]
    steps, epochs = 0, max(1, STEPS * BATCH // max(BATCH, len(rows)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            chosen = order[k:k + BATCH]
            _, grads = gradients(params, [docs[i] for i in chosen], labels[chosen])
            steps += 1
            for q, g, (m1, m2) in zip(params, grads, moment, strict=True):
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                q -= rate * (m1 / (1 - 0.9**steps)) / (np.sqrt(m2 / (1 - 0.999**steps)) + 1e-8)
    return Model(params[0], params[1], params[2], float(params[3][0]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text is a multiple of 5 (null: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT) -> list[tuple[bytes, int]]:
    """The training sample: whole texts and labels of at most ``max_rows`` rows and ``max_bytes`` bytes, all else being left in the executors.

    Of labelled rows that are not held out, those of the least hash of id and text, a uniform sample however often an id occurs; equal rows
    count once. Texts of more than ``max_text`` bytes are no candidates. Rows with a null id or label are left out; a null text is an empty one.
    """
    known = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    first = known.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(max_rows)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    texts = docs.select(column(id_col).alias("d"), text.alias("t")).where(F.octet_length("t") <= max_text)
    pool = texts.join(F.broadcast(first), F.col("d") == F.col("id")).select("id", "y", "t").withColumns({"a": F.xxhash64("id"), "b": F.xxhash64("t"), "c": F.xxhash64(F.lit(1), "t")})
    pool = materialize(pool.dropDuplicates(["id", "y", "b", "c"]))
    order = ["a", "b", "c", "id", "y"]
    places = pool.select(*order, F.octet_length("t").alias("n")).orderBy(*order).limit(max_rows).collect()
    used, last = 0, 0
    for r in places:
        used += r["n"]
        if used > max_bytes:
            break
        last += 1
    if not last:
        return []
    chosen = pool.join(F.broadcast(pool.select(*order).orderBy(*order).limit(last)), order, "left_semi") if last < len(places) or len(places) == max_rows else pool
    found = chosen.select(*order, "t").collect()
    return [(r["t"].encode(), r["y"]) for r in sorted(found, key=lambda r: tuple(r[c] for c in order))]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> Model:
    """Train on the whole texts of ``sample`` (whose bounds can be given). Without labels, or with one label only, the model is that share, for every text."""
    return train(sample(docs, labels, label_col, id_col, text_col, **bounds))


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of the whole text; a null or empty text is one chunk of padding.

    Repeated rows stay, other columns pass through, one named as the output column is replaced; nothing is shuffled.
    """
    ship_code(docs.sparkSession)
    kept = [c for c in docs.columns if c != out_col]
    rest = [c for c in kept if c != text_col]
    rows = docs.select(packed(rest), column(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.pairs()
        for batch in batches:
            for s, texts in text_blocks(batch.column(1)):
                found = predict(model, [t.encode() for t in texts], tables)
                yield pa.RecordBatch.from_arrays([*batch.slice(s.start, len(found)).columns, pa.array(found)], names=["row", "text", "score"])

    scored = rows.mapInArrow(run, schema_with(rows, ["row", "text"], {"score": "double"}))
    columns = dict(zip(rest, unpacked(rest), strict=True)) | {text_col: F.col("text").alias(text_col)}
    return scored.select(*[columns[c] for c in kept], F.col("score").alias(out_col))
