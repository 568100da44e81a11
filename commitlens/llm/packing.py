"""Operator 9 - sum-of-squares packing of token sequences.

Each document becomes token ids (byte-level BPE file given by path) plus an end id;
documents over the limit are cut, the remainder first, so that all other pieces are
full.  Full pieces need no search.  The rest are dealt at random to shards of
a bounded number of pieces; each shard places its pieces, longest first, where the
sum over residual gaps of (open bins with that gap) squared becomes smallest.  (In
falling order this packs as tightly as best-fit decreasing.)

One shuffle, of (id, piece, length) rows; ids and texts never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
END_ID = 2
SHARD_PIECES = 200_000   # about so many pieces meet in one task; bounds its memory, and the bins left open once per shard
LONG_RUN = r"\s{5000}|\S{5000}"   # the faster encoder recurses over such runs
PLAIN = r"^[\t\n\r\x20-\x7e¡-ɏ]*$"


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the tokenizer file.

    Texts of common Latin characters take a faster encoder of the same vocabulary and split
    pattern, which gives the same ids (tested); any other text, and a text that
    spells a special token, goes through the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import base64
            import re

            import public_tokenizers as public
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.plain, self.long_run = re.compile(PLAIN), re.compile(LONG_RUN)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and self.plain.match(text) and not any(s in text for s in self.special) and not self.long_run.search(text):
            return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4")


def cuts(n: int, limit: int) -> list[int]:
    """Starts of the pieces of a document of ``n`` ids: the remainder first, then full pieces."""
    first = n % limit
    return ([0] if first else []) + list(range(first, n, limit))


def piece_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID,
               vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32) rows, made where the documents are read."""
    paths = vocabulary or default_vocabulary()
    plain = docs.select(F.col(f"`{id_col}`").alias("_x_id"), F.col(f"`{text_col}`").cast("string").alias("_x_text"))
    id_type = plain.schema["_x_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            encode = encode or Encoder(*paths)
            rows, piece, start, length, crc = [], [], [], [], []
            texts = b.column(1)
            for i in range(b.num_rows):
                ids = np.append(encode(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, s in enumerate(at := cuts(len(ids), limit)):
                    e = at[k + 1] if k + 1 < len(at) else len(ids)
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["_x_id", "piece", "start", "length", "ids_crc32"])

    return plain.mapInArrow(run, f"_x_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, placed in the given order.

    Moving a bin from gap g to gap g - length changes the sum of squared counts by
    2 * (count[g - length] - count[g]) + 2, or by 1 - 2 * count[g] if that fills the bin; the smallest
    change wins, then the smallest gap.  A bin is opened only when no open one has room: letting
    the rule open bins freely takes over 1 % more of them on lengths sorted in falling order.
    """
    count = np.zeros(limit + 1, np.int64)
    by_gap: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        old = count[s:limit]
        if old.any():
            change = 2 * (count[:limit - s] - old) + 2
            change[0] = 1 - 2 * old[0]
            g = s + int(np.where(old > 0, change, never).argmin())
            b = by_gap[g].pop()
            count[g] -= 1
        else:
            g, b, opened = limit, opened, opened + 1
        bins[i], offsets[i] = b, limit - g
        if g > s:
            count[g - s] += 1
            by_gap[g - s].append(b)
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID,
         vocabulary: tuple[str, str | None] | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequence numbers are unique, not dense: shard * 2^40 + number in the shard.  The result
    depends on the rows only, not on how they are partitioned.

    Defined results: a null or empty text is the end id alone; null ids and repeated rows are
    packed like any other row; no row, no sequence; extra columns are ignored.
    """
    pieces = piece_rows(docs, id_col, text_col, limit, end_id, vocabulary)
    shards = max(1, -(-docs.count() // shard_pieces))   # a document has at most one piece that is not full
    id_type = pieces.schema["_x_id"].dataType.simpleString()
    out = f"_x_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    dealt = pieces.withColumn("_x_shard", F.pmod(F.xxhash64("_x_id", "ids_crc32", "piece", F.lit(7)), F.lit(shards)).cast("int"))

    def place(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("_x_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(t.column("length").to_numpy(), limit)
        bins += key[0].as_py() << 40
        return (t.drop_columns(["_x_shard"]).append_column("sequence_id", pa.array(bins))
                .append_column("offset", pa.array(offsets)))

    packed = dealt.groupBy("_x_shard").applyInArrow(place, out)
    return packed.withColumnRenamed("_x_id", id_col)
