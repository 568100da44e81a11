"""Operator 13 - importance resampling towards a target distribution, with a position-table CRC.

Features are runs of 1 to ``orders`` consecutive words.  The bucket of a feature is its CRC-32 modulo
``buckets``.  CRC-32 is affine over XOR, so the CRC of a span is the XOR of one table entry per byte, chosen by the
byte and its distance from the end of the span, and of a constant that depends on the length only.  All
spans of a piece of text are folded at once by ``bitwise_xor.reduceat``; spans longer than the table are
cut into blocks from their end, and each block's value is moved past the bytes behind it by
the zero-byte operators before the blocks are folded.

One pass counts features per bucket over all rows of both tables (each task sends one row per bucket it has
seen; a table of ``buckets`` numbers reaches the driver), one pass sums the gains of each text.  Scores
add a Gumbel value drawn from the id, so the highest scores are a sample without replacement; ranks come from a range
sort and partition offsets, never from one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise
from commitlens.llm.tokens import slices, words
from commitlens.operators.numbering import row_numbers

POLYNOMIAL = 0xEDB88320   # CRC-32 as zlib, gzip and PNG use it
REACH = 64                # bytes that the position table covers
PIECE = 1 << 18           # bytes folded at once
BUCKETS = 10_000
ORDERS = 1
SEED = 2024
SHARE_PCT = 10
MIN_WORDS = 20


def _one_byte() -> np.ndarray:
    """Register after one byte, from a zero register."""
    reg = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        reg = np.where(reg & 1, (reg >> 1) ^ np.uint32(POLYNOMIAL), reg >> 1)
    return reg


def _apply(op: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """A linear operator (one table per register byte) on many registers."""
    out = op[0][reg & 255]
    for i in range(1, 4):
        out = out ^ op[i][(reg >> np.uint32(8 * i)) & 255]
    return out


def _zero_operators() -> list[np.ndarray]:
    """Operator i moves a register past 2**i zero bytes."""
    first = _one_byte()
    byte = np.arange(256, dtype=np.uint32)
    one = np.stack([first, *[byte << np.uint32(8 * (i - 1)) for i in range(1, 4)]])
    ops = [one]
    while len(ops) < 40:
        ops.append(_apply(ops[-1], ops[-1]))
    return ops


OPERATORS = _zero_operators()


def _positions() -> np.ndarray:
    rows = [_one_byte()]
    while len(rows) < REACH:
        rows.append(_apply(OPERATORS[0], rows[-1]))
    return np.concatenate(rows)


POSITIONS = _positions()   # entry 256 * distance + byte


def move(reg: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each register past its own number of zero bytes."""
    for i in range(int(n.max(initial=0)).bit_length()):
        reg = np.where((n >> i) & 1, _apply(OPERATORS[i], reg), reg)
    return reg


def span_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans (at least one byte each; they may overlap) of a byte array."""
    if not len(start):
        return np.zeros(0, np.uint32)
    blocks = -(-length // REACH)
    first = np.cumsum(blocks) - blocks
    behind = np.repeat(first + blocks, blocks) - 1 - np.arange(int(blocks.sum()))     # blocks behind it in its span
    end = np.repeat(start + length, blocks) - behind * REACH
    begin = np.maximum(np.repeat(start, blocks), end - REACH)
    size = end - begin
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(offset, size)
    byte = data[np.repeat(begin, size) + place]
    distance = np.repeat(size, size) - 1 - place
    folded = np.bitwise_xor.reduceat(POSITIONS[distance * 256 + byte], offset)
    if blocks.max() > 1:
        folded = np.bitwise_xor.reduceat(move(folded, behind * REACH), first)
    lengths, which = np.unique(length, return_inverse=True)
    constant = move(np.full(len(lengths), 0xFFFFFFFF, np.uint32), lengths) ^ np.uint32(0xFFFFFFFF)
    return folded ^ constant[which]


def feature_crcs(parts: list[bytes], orders: int) -> np.ndarray:
    """CRCs of all runs of 1 to ``orders`` words; ``PIECE`` bytes of whole words at a time."""
    out, at = [], 0
    while at < len(parts):
        stop, held = at, 0
        while stop < len(parts) and (held < PIECE or stop == at):
            held += len(parts[stop]) + 1
            stop += 1
        piece = parts[at:stop + orders - 1]                  # runs that begin here may end in the next words
        data = np.frombuffer(b" ".join(piece), np.uint8)
        size = np.array([len(p) for p in piece], np.int64)
        start = np.cumsum(size + 1) - size - 1
        for n in range(1, orders + 1):
            begin = np.arange(min(stop - at, len(piece) - n + 1))
            out.append(span_crcs(data, start[begin], start[begin + n - 1] + size[begin + n - 1] - start[begin]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def text_features(texts: list[str | None], orders: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, words of each text, CRCs of all of them text after text); for one order texts are folded together."""
    if orders > 1:
        for i, t in enumerate(texts):
            w = words(t)
            yield i, np.array([len(w)]), feature_crcs(w, orders)
        return
    each = [words(t) for t in texts]
    yield 0, np.array([len(w) for w in each], np.int64), feature_crcs([x for w in each for x in w], 1)


def n_runs(n_words: np.ndarray, orders: int) -> np.ndarray:
    return sum(np.maximum(0, n_words - o) for o in range(orders))


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, orders: int) -> dict[int, int]:
    """Features per bucket over all rows; at most ``buckets`` numbers come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, _, crc in text_features(batch.column(0).to_pylist(), orders):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text_col}`").alias("_x_text")).mapInArrow(count, "bucket long, n long")
    return {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) per bucket, both with one added to each bucket."""
    s = np.array([source.get(b, 0) for b in range(buckets)], np.int64)
    t = np.array([target.get(b, 0) for b in range(buckets)], np.int64)
    ratio = ((t + 1) * (s.sum() + buckets)).astype(float) / ((s + 1) * (t.sum() + buckets)).astype(float)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, text_col: str, gain: np.ndarray, orders: int) -> DataFrame:
    """The rows with ``_x_words``, ``_x_n`` (features) and ``_x_w`` (sum of gains) in place of the text."""
    buckets = len(gain)
    rows = docs.withColumn("_x_text", F.col(f"`{text_col}`")).drop(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            table = pa.Table.from_batches([batch])
            n_words = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows, np.int64)
            for first, n, crc in text_features(table["_x_text"].to_pylist(), orders):
                n_words[first:first + len(n)] = n
                total = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(buckets)])])
                ends = np.cumsum(n_runs(n, orders))
                weight[first:first + len(n)] = total[ends] - total[ends - n_runs(n, orders)]
            out = table.drop_columns(["_x_text"])
            for name, values in (("_x_words", n_words), ("_x_n", n_runs(n_words, orders)), ("_x_w", weight)):
                out = out.append_column(name, pa.array(values, pa.int64()))
            yield from out.to_batches()

    schema = rows.drop("_x_text").schema.add("_x_words", "long").add("_x_n", "long").add("_x_w", "long")
    return rows.mapInArrow(score, schema)


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of a SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, orders: int = ORDERS, share_pct: int = SHARE_PCT, min_words: int = MIN_WORDS,
             seed: int = SEED) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    ``rank`` counts from 1 over the drawn rows by falling score, ties by rising id; it is null for the others.
    Of the rows with an id and at least ``min_words`` words, floor(share_pct * rows / 100) are drawn.  Defined results: a
    null or empty text has no feature and the weight 0; a row with a null id is counted in the distributions, has a null score and
    is not drawn; repeated rows are rows of their own and follow each other in the ranking; an empty table gives no
    rows, an empty target makes all features alike; other columns of the input are not looked at.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, orders), bucket_counts(target, target_text, buckets, orders), buckets)
    rows = weigh(docs.select(F.col(f"`{id_col}`").alias("_x_id"), F.col(f"`{text_col}`").alias("_x_t")), "_x_t", gain, orders)
    # written: the range sort reads its input twice, and the texts should not be
    scored = materialise(rows.select("_x_id", "_x_words", "_x_n", "_x_w", (F.col("_x_w") + gumbel(F.col("_x_id"), seed)).alias("_x_score"),
                                     (F.col("_x_id").isNotNull() & (F.col("_x_words") >= min_words)).alias("_x_open")), "scored")
    ranked, n_open = row_numbers(scored, [F.col("_x_open").desc(), F.col("_x_score").desc(), F.col("_x_id").asc()], "_x_rank", "_x_open")
    drawn = F.col("_x_open") & (F.col("_x_rank") <= share_pct * n_open // 100)
    return ranked.select(F.col("_x_id").alias(id_col), F.col("_x_words").alias("n_words"), F.col("_x_n").alias("n_features"),
                         F.col("_x_w").alias("weight"), F.col("_x_score").alias("score"), F.when(drawn, F.col("_x_rank")).alias("rank"))
