"""Token ids as Parquet list columns, in order of document id, for selective reads.

Each file holds rows sorted by id: ``doc_id``, ``part`` and ``row`` (place in the store),
``part_start`` (ids before the row in its part), ``n_tokens`` and the list ``ids``. The list is
dictionary encoded (a page of 50,000 ids fits), the sorted and counted columns are delta encoded
(data page version 2). Row groups and pages are kept small, and each column chunk has a page index,
so a filter on doc_id reads the pages that can hold it, and reading metadata never touches the ids.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import ship_code, small
from .word_cache import WordCache, column_blocks, kept

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 2_000
#: Bytes of text whose different parts are looked up at once.
TEXT_BLOCK = 4_000_000
#: Signs that end a word: the pre-tokenizer always begins a new piece with one after a letter, whatever follows.
SIGNS = ",.;:!?"
#: The last of the Latin letters, on which all versions of Unicode agree.
LAST_LATIN = "\u024f"

_CACHES: dict[bytes, WordCache] = kept()


def checked(source: bytes) -> bytes:
    """The tokenizer's JSON, if its texts may be cut before single spaces: a byte-level BPE without normalizer, prefix space or other pre-tokenizers."""
    spec = json.loads(source)
    cutter = spec.get("pre_tokenizer") or {}
    added = [t["content"] for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"])]
    model = spec["model"]
    if (cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True) or spec.get("normalizer") or added
            or model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")):
        raise ValueError("only a byte-level BPE without normalizer, prefix space or added tokens that take white space can be encoded by parts")
    return source


def library_cache(source: bytes) -> WordCache:
    """A word cache over the tokenizers library, one for each Python worker."""
    key = hashlib.sha256(source).digest()
    if key not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(source.decode())
        t.no_truncation()
        t.no_padding()
        model = t.model
        size = np.zeros(t.get_vocab_size(True), np.int64)  # bytes of each token; a byte-level vocabulary writes a byte as one letter
        for name, i in t.get_vocab(False).items():
            size[i] = len(name)
        for i, added in t.get_added_tokens_decoder().items():
            size[i] = len(added.content.encode())

        signs = "".join(c for c in SIGNS if not any(c in a.content for a in t.get_added_tokens_decoder().values()))

        def apart(parts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in t.encode_batch_fast(parts, add_special_tokens=False)]

        letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})
        by_model = not any(a.content.isalpha() for a in t.get_added_tokens_decoder().values())

        def words(parts: list[str]) -> list[bytes]:
            """Of a space and Latin letters each: one piece to the pre-tokenizer, so the library's model may take them at once."""
            pieces = "".join(parts).encode().decode("latin-1").translate(letters).split(letters[32])[1:]
            return [array("I", [x.id for x in model.tokenize(letters[32] + p)]).tobytes() for p in pieces]

        def new(parts: list[str]) -> list[bytes]:
            plain = [i for i, p in enumerate(parts) if p[0] == " " and p[1:].isalpha() and (p.isascii() or max(p) <= LAST_LATIN)] if by_model else []
            if not plain:
                return together(parts)
            out = dict(zip(plain, words([parts[i] for i in plain]), strict=True))
            rest = iter(together([p for i, p in enumerate(parts) if i not in out]))
            return [out[i] if i in out else next(rest) for i in range(len(parts))]

        def together(parts: list[str]) -> list[bytes]:
            """As one text, since parts that end with a word do not act on the next one, which begins with white space or else is encoded apart: ids tile the bytes, so they can be told apart again."""
            if len(parts) < 2:
                return apart(parts)
            if odd := [i for i, p in enumerate(parts) if p[-1].isspace() or p[0] in signs]:
                out = dict(zip(odd, apart([parts[i] for i in odd]), strict=True))
                rest = iter(together([p for i, p in enumerate(parts) if i not in out]))
                return [out[i] if i in out else next(rest) for i in range(len(parts))]
            ids = np.array(t.encode_batch_fast(["".join(parts)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(size[ids].cumsum(), np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts)).cumsum()) + 1
            flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            return [flat[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

        _CACHES[key] = WordCache(new, apart, signs=signs)
    return _CACHES[key]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to ``path`` in ascending order of ``id_col``.

    A null or empty text holds ``end_id`` alone. Null ids come first; rows of equal id are ordered by a hash
    of the text, so an id that many rows share is still spread over tasks; repeated rows all stay. Other columns are
    not written. An empty table gives an empty store. ``tokenizer`` is the path of a byte-level BPE whose texts may be cut before
    single spaces; others raise a ValueError.
    """
    spark = docs.sparkSession
    ship_code(spark)
    source = spark.sparkContext.broadcast(checked(Path(tokenizer).read_bytes()))
    id_type = dict(docs.dtypes)[id_col]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part, row, start = library_cache(source.value), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for s in column_blocks(batch.column(1), TEXT_BLOCK):
                rows = s.stop - s.start
                ends, flat = cache.encode_column(batch.column(1).slice(s.start, rows), tail)
                starts = np.r_[0, ends // 4]
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(np.frombuffer(flat, "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.start, rows), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(row, row + rows)),
                     pa.array(start + starts[:-1]), pa.array(np.diff(starts)), lists], names=["doc_id", "part", "row", "part_start", "n_tokens", "ids"])
                row, start = row + rows, start + int(starts[-1])

    salt = F.xxhash64("text")
    ordered = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
               .repartitionByRange("doc_id", salt).sortWithinPartitions("doc_id", salt, "text"))
    out = ordered.mapInArrow(run, f"doc_id {id_type}, part int, row long, part_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS, "parquet.writer.version": "PARQUET_2_0",
               "parquet.enable.dictionary": "true", "compression": "snappy"} | {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "row", "part_start", "n_tokens")}
    out.write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store: select columns and filter on doc_id before use, so only what is asked for is read."""
    return spark.read.parquet(path)


def metadata(store: DataFrame) -> DataFrame:
    """doc_id, part, row, start (ids of all documents before it) and n_tokens; the ids are not read."""
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file
    offsets = parts.select(F.col("part").alias("_p"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    return store.join(small(offsets), F.col("part") == F.col("_p")).withColumn("start", F.col("_off") + F.col("part_start")).drop("_p", "_off")


def checksums(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted in the lists read) and ids_crc32 of each row's ids as little-endian 32-bit integers."""
    ship_code(store.sparkSession)
    id_type = dict(store.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            base = int(ends[0])
            flat = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(), "<i4").tobytes())
            cuts = ((ends - base) * 4).tolist()
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return metadata(store).select("doc_id", "start", "ids").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")
