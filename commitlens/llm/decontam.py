"""Operator 3 - benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of ``WINDOW`` words, as TF-IDF vectors over ``FEATURES`` hashed words; document
frequencies come from all documents.  A randomised SVD (subspace iteration) gives ``RANK`` right singular vectors: each
iteration multiplies the passage matrix and its transpose with a panel of fixed size inside the tasks, Spark sums
the panels, and the driver only orthogonalises FEATURES x (RANK + 8) numbers.  The vectors are fitted on the passages of all
documents and all items, the latter weighted up so that their directions are kept.  For the fit each text is written
once as the buckets of its words, 2 bytes a word, which every pass over the matrix reads.

Every passage is compared with every benchmark passage by cosine in the latent space, benchmark passages in
blocks of at most ``ITEM_BLOCK``.  Candidates are checked on the words: longest common subsequence with the item and
its density, and for weaker matches (paraphrases) whether the item's answer, its last sentence or a column of its own, is
there too.  The item's words that stand near a passage bound the subsequence from above; that bound and the length of the
subsequence itself, found for many candidates at once, spare checks.

Shuffles: document frequencies (one row per word bucket and task), panels of the fit (9 MB per iteration and task, two tasks a core), best match per (document, item).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import let, materialise
from commitlens.llm.shingles import word_hashes

FEATURES = 1 << 15
RANK = 128
OVERSAMPLE = 8
ITERATIONS = 2
WINDOW, STEP = 64, 32
ITEM_STEP = 16           # words between passages of a long item: WINDOW * (1 - NEAR_LCS), so that a run of WINDOW * NEAR_LCS words is whole in one
FEW = 8                  # an item of fewer words must stand in the document word for word, with its answer
PARTS = 1024             # a panel travels in so many parts, of 9 KB each
FIT_WEIGHT = 3.0
FIT_WORDS = 1 << 19      # words multiplied at once in the fit
GROUP = 512              # sums made at once: they and the rows added to them stay in a core's cache
RUN = 32                 # rows of a feature added up in one go
FIT_TASKS = 2            # tasks a core that multiply the passages: each sends a panel of 9 MB per iteration
ITEM_BLOCK = 2048        # benchmark passages searched at once: bounds what tasks receive to a few MB
CHUNK = 1 << 18          # text bytes handled at once: a worker holds about 100 vectors' bytes per text byte
SLICE = 1 << 12          # passages compared with the items at once
MIN_COSINE = 0.40        # found all copies down to 0.55 on the given tables, and paraphrases with 45 % of the words swapped
SHORT = 0.7              # ... but at most this times sqrt(words / WINDOW): a short item fills little of a passage
NEAR_LCS = 0.75          # share of the item's words in a common subsequence: a copy
PARAPHRASE_LCS = 0.5     # the same when the answer is there too
ANSWER_LCS = 0.8
DENSITY = 0.5            # common words by words spanned in the document

# ASCII punctuation separates words
FOLD = bytes(32 if 32 < c < 127 and not chr(c).isalnum() else c for c in range(256))
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges with about CHUNK characters of text."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(w: np.ndarray) -> np.ndarray:
    return (w >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64)


def text_features(texts: DataFrame, text_col: str) -> DataFrame:
    """(``words``): the buckets of each text's words in order, 2 bytes each; one row per text, null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            out: list[bytes] = []
            for s, e in slices(texts):
                w, n = word_hashes(texts[s:e], FOLD)
                data = features(w).astype(np.uint16).tobytes()
                ends = (np.cumsum(n) * 2).tolist()
                out += [data[i:j] for i, j in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["words"])

    return texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "words binary")


def word_slices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, slice]]:
    """(buckets, words of each text, which texts) of a ``words`` column, about FIT_WORDS words at a time."""
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + FIT_WORDS, "right")))
        yield np.frombuffer(b"".join(column.slice(at, end - at).to_pylist()), np.uint16).astype(np.int64), n[at:end], slice(at, end)
        at = end


def idf_weights(docs: DataFrame, text_col: str) -> np.ndarray:
    """``word_idf`` of the texts of a table."""
    return word_idf(text_features(docs, text_col))


def word_idf(words: DataFrame) -> np.ndarray:
    """log((1 + N) / (1 + documents with the word)) + 1 by word bucket, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for f, n, _ in word_slices(b.column(0)):
                seen = np.sort(np.repeat(np.arange(len(n)), n) * FEATURES + f)
                seen = seen[np.flatnonzero(np.diff(seen, prepend=-1))]
                total[:FEATURES] += np.bincount(seen % FEATURES, minlength=FEATURES)
                total[FEATURES] += len(n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["f", "n"])

    sums = words.select("words").mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    df = np.zeros(FEATURES + 1)
    for r in sums.collect():      # FEATURES + 1 rows at most
        df[r.f] = r.n
    return (np.log((1 + df[FEATURES]) / (1 + df[:FEATURES])) + 1).astype(np.float32)


def place_of(n: np.ndarray) -> np.ndarray:
    """Place of every word in its text."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def block_of(n: np.ndarray) -> np.ndarray:
    """Number of every word's block of STEP words, counted over all texts."""
    blocks = -(-n // STEP)
    return np.repeat(np.cumsum(blocks) - blocks, n) + place_of(n) // STEP


def with_zero_row(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros_like(table[:1])])


def group_sums(table: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``table[at]`` over runs of ``n`` of them; the last row of ``table`` is zero.

    GROUP runs of about the same length are summed together, their first rows, their second rows and so on.
    """
    out = np.zeros((len(n), table.shape[1]), np.float32)
    at = np.append(at, len(table) - 1)
    first = np.cumsum(n) - n
    order = np.argsort(-n, kind="stable")
    sums, more = np.empty((2, GROUP, table.shape[1]), np.float32)
    for s in range(0, len(n), GROUP):
        runs = order[s:s + GROUP]
        k = np.arange(n[runs[0]])[:, None]
        if not len(k):
            break
        rows = at[np.where(k < n[runs], first[runs] + k, len(at) - 1)]
        a, b = sums[:len(runs)], more[:len(runs)]
        np.take(table, rows[0], axis=0, out=a, mode="clip")
        for r in rows[1:]:
            np.take(table, r, axis=0, out=b, mode="clip")
            np.add(a, b, out=a)
        out[runs] = a
    return out


def run_lengths(n: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the runs into which runs of ``n`` are cut: ``most`` each, but the last of each."""
    pieces = -(-n // most)
    out = np.full(int(pieces.sum()), most)
    some = n > 0
    out[(np.cumsum(pieces) - 1)[some]] = (n - (pieces - 1) * most)[some]
    return out


def add_by_feature(out: np.ndarray, f: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
    """``out[f] += rows[at]``, all rows of a feature."""
    order = np.argsort(f.astype(np.uint16), kind="stable")
    key, at = f[order], at[order]
    while len(key):
        start = np.flatnonzero(np.diff(key, prepend=-1))
        n = np.diff(start, append=len(key))
        runs = run_lengths(n, RUN)
        rows = group_sums(with_zero_row(rows), at, runs)
        if len(runs) == len(n):
            out[key[start]] += rows
            return
        key, at = np.repeat(key[start], -(-n // RUN)), np.arange(len(runs))


def windows(w: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, text, first word in the text) of all passages: sums of ``table`` rows over the words; its last row is zero."""
    return bucket_windows(features(w), n, table)


def bucket_windows(f: np.ndarray, n: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows`` of words given by their buckets."""
    blocks = -(-n // STEP)
    owner = np.repeat(np.arange(len(n)), blocks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    if not len(owner):
        return np.zeros((0, table.shape[1]), np.float32), owner, place
    sums = group_sums(table, f, run_lengths(n, STEP))
    nxt = np.zeros(len(owner), bool)
    nxt[:-1] = owner[1:] == owner[:-1]
    sums[:-1][nxt[:-1]] += sums[1:][nxt[:-1]]
    keep = nxt | (place == 0)
    return sums[keep], owner[keep], place[keep] * STEP


def panel(rows: DataFrame, table: np.ndarray, idf: np.ndarray, gram: bool = False) -> np.ndarray:
    """Transposed matrix times (matrix times ``table``), summed by Spark; rows (words, weight) are cut into normalised passages.

    ``gram``: (matrix times ``table``) transposed times itself instead.  Panels travel in half precision, which costs
    less disk for the broadcast and is far finer than what the iteration needs.
    """
    width = table.shape[1]
    scale_up = float(FEATURES) ** 0.5
    shared = rows.sparkSession.sparkContext.broadcast(((table * scale_up).astype(np.float16), idf))
    height = width if gram else FEATURES
    step = height if gram else FEATURES // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = shared.value
        q = q.astype(np.float32) / np.float32(scale_up)
        wide = with_zero_row(np.concatenate([q * weight[:, None], (weight ** 2)[:, None]], axis=1).astype(np.float32))
        out = np.zeros((height, width), np.float64 if gram else np.float32)
        for b in batches:
            scale = b.column(1).to_numpy(zero_copy_only=False)
            for f, n, at in word_slices(b.column(0)):
                y, owner, first = bucket_windows(f, n, wide)
                y = y[:, :-1] * (scale[at][owner] ** (1 if gram else 2) / np.maximum(y[:, -1], 1e-9) ** (0.5 if gram else 1)).astype(np.float32)[:, None]
                if gram:
                    out += y.T @ y
                    continue
                blocks = -(-n // STEP)
                base = np.cumsum(blocks) - blocks
                grad = np.zeros((int(blocks.sum()), width), np.float32)
                at = base[owner] + first // STEP            # one passage begins at a block
                grad[at] = y
                two = first // STEP + 1 < blocks[owner]
                grad[at[two] + 1] += y[two]
                add_by_feature(out, f, grad, block_of(n))
        if not out.any():
            return
        if not gram:
            out *= weight[:, None]
        top = max(float(np.abs(out).max()), 1e-30)
        parts = range(height // step)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([top] * len(parts)),
                                          pa.array([(out[i * step:(i + 1) * step] / top * 1000).astype(np.float16).tobytes() for i in parts], pa.binary())], ["part", "top", "z"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z: dict[int, np.ndarray] = {}           # a panel at most, whatever the number of tasks
        for b in batches:
            for part, top, x in zip(*[c.to_pylist() for c in b.columns]):
                z[part] = z.get(part, 0) + np.frombuffer(x, np.float16).astype(np.float64) * (top / 1000)
        yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in z.values()], pa.binary())], ["part", "z"])

    tasks = FIT_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    sent = rows.select("words", "weight").coalesce(tasks).mapInArrow(run, "part int, top double, z binary")
    total = np.zeros((height, width), np.float32)
    for r in sent.repartition("part").mapInArrow(add, "part int, z binary").toLocalIterator():     # FEATURES x width numbers, a part at a time
        total[r.part * step:(r.part + 1) * step] = np.frombuffer(r.z, np.float32).reshape(-1, width)
    shared.destroy()
    return total


def orthonormal(q: np.ndarray) -> np.ndarray:
    """Orthonormal columns with the same span, in place: twice by the Cholesky factor of the small Gram matrix, a few rows at a time."""
    for _ in range(2):
        gram = np.zeros((q.shape[1], q.shape[1]))
        for i in range(0, len(q), SLICE):
            part = q[i:i + SLICE].astype(np.float64)
            gram += part.T @ part
        gram[np.diag_indices_from(gram)] += 1e-12 * np.trace(gram) + 1e-300
        back = np.linalg.inv(np.linalg.cholesky(gram)).T
        for i in range(0, len(q), SLICE):
            q[i:i + SLICE] = q[i:i + SLICE] @ back
    return q


def singular_vectors(rows: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """FEATURES x rank: right singular vectors of the passage matrix."""
    q = np.random.default_rng(3).standard_normal((FEATURES, rank + OVERSAMPLE), np.float32)
    for _ in range(ITERATIONS):
        q = orthonormal(panel(rows, q, idf))
    values, u = np.linalg.eigh(panel(rows, q, idf, gram=True).astype(np.float64))
    return q @ u[:, np.argsort(values)[::-1][:rank]].astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def subsequence_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``common_subsequence`` of each row of ``a`` (64 words) with the row of ``b``, all rows at once."""
    same = np.packbits(a[:, None, :] == b[:, :, None], axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    v = np.full(len(a), ~np.uint64(0))
    for m in np.ascontiguousarray(same.T):
        u = v & m
        v = (v + u) | (v - u)
    return 64 - np.bitwise_count(v).astype(np.int64)


@dataclass
class Item:
    words: list[int]
    answer: list[int]


def whole(item: Item, region: list[int]) -> tuple[float, int, int, float] | None:
    """``match`` for an item of few words: all of them in a row, and its answer if it has one."""
    n = len(item.words)
    answer = common_subsequence(item.answer, region) / len(item.answer) if item.answer else 0.0
    if item.answer and answer < ANSWER_LCS:
        return None
    at = next((i for i in range(len(region) - n + 1) if region[i:i + n] == item.words), None)
    return None if at is None else (1.0, at, n, answer)


def match(item: Item, region: list[int]) -> tuple[float, int, int, float] | None:
    """(LCS share, first word, words spanned, answer share) if the region repeats or paraphrases the item."""
    if len(item.words) < FEW:
        return whole(item, region)
    best = common_subsequence(item.words, region)
    share = best / len(item.words)
    if share < PARAPHRASE_LCS:
        return None
    lo, hi = 0, len(region)         # the longest subsequence stays until the region is cut too far
    low, high = 0, len(region)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if common_subsequence(item.words, region[mid:]) == best else (low, mid - 1)
    lo, low, high = low, low, hi
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if common_subsequence(item.words, region[lo:mid]) == best else (mid + 1, high)
    hi = low
    answer = common_subsequence(item.answer, region) / len(item.answer) if item.answer else 0.0
    if best < DENSITY * (hi - lo) or not (share >= NEAR_LCS or answer >= ANSWER_LCS):
        return None
    return share, lo, hi - lo, answer


class WordBound:
    """Upper bound of the common subsequence of passages and items: item words whose bucket stands in the passage or a block beside it.

    Buckets and blocks of a neighbouring text can only raise the bound, so no match is lost.
    """

    def __init__(self, items: list[np.ndarray]):
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *items]))
        self.slot = np.full(FEATURES, -1)
        self.slot[used] = np.arange(len(used))
        self.width = len(used) + 1                 # the last column is false and fills up shorter items
        self.n = np.array([len(f) for f in items])
        self.slots = np.full((len(items), max(1, int(self.n.max()))), len(used))
        for row, f in zip(self.slots, items):
            row[:len(f)] = self.slot[f]
        self.passages = max(1, min(SLICE, (1 << 25) // self.width))   # 32 MB or so of flags at once

    def may_match(self, block: np.ndarray, slot: np.ndarray, home: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs (passage i, item j): whether the bound allows a match.  ``block`` (rising) and ``slot``: item words of the texts; ``home``: first block of each passage."""
        if not len(i):
            return np.zeros(0, bool)
        low, high = int(home[0]) - 1, int(home[-1]) + 3
        at = slice(*np.searchsorted(block, [low, high]))
        flags = np.zeros((high - low, self.width), bool)
        flags[block[at] - low, slot[at]] = True
        some, row = np.unique(i, return_inverse=True)
        own = home[some] - low
        near = (flags[own - 1] | flags[own] | flags[own + 1] | flags[own + 2]).view(np.uint8).ravel()
        out = np.empty(len(i), bool)
        for s in range(0, len(i), 1 << 11):
            part = slice(s, s + (1 << 11))
            held = near.take(self.slots[j[part]] + row[part, None] * self.width)
            out[part] = held.sum(axis=1, dtype=np.uint16) >= PARAPHRASE_LCS * self.n[j[part]]
        return out


class OrderBound:
    """Upper bound of the common subsequence of regions and items: that of 16 bits of their words' hashes.  Items of few words are not judged.

    Equal bits of other words can only raise the bound, so no match is lost.
    """

    def __init__(self, items: list[list[int]]):
        self.n = np.array([len(x) for x in items])
        self.judged = (self.n >= FEW) & (self.n <= 64)
        self.words = np.zeros((len(items), 64), np.uint16)     # shorter items are filled up with a word, which can only raise the bound too
        for row, x in zip(self.words, items):
            row[:len(x)] = np.array(x[:64], np.uint64).astype(np.uint16)

    def may_match(self, w: np.ndarray, lo: np.ndarray, hi: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs (region lo to hi of the words ``w``, item j): whether the bound allows a match."""
        out = ~self.judged[j]
        w = np.append(w.astype(np.uint16), np.uint16(1))
        some = np.flatnonzero(~out)
        for s in range(0, len(some), 128):
            part = some[s:s + 128]
            at = lo[part, None] + np.arange(int((hi[part] - lo[part]).max()))
            regions = w[np.where(at < hi[part, None], at, len(w) - 1)]
            out[part] = subsequence_lengths(self.words[j[part]], regions) >= PARAPHRASE_LCS * self.n[j[part]]
        return out


def last_sentence(text: Column) -> Column:
    filled = lambda parts: F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"\S")))
    line = F.get(F.reverse(filled(F.split(text, "\n", -1))), F.lit(0))
    return F.get(F.reverse(filled(F.split(line, r"\. ", -1))), F.lit(0))


def search(docs: DataFrame, items: list[tuple[object, str, str]], vectors: np.ndarray, idf: np.ndarray, id_col: str, text_col: str,
           key_type: str, min_cosine: float, check: bool = True) -> DataFrame:
    """(_x_id, item, cosine, lcs, first_word, n_words, answer): checked matches of one block of items with all passages."""
    plain = docs.select(F.col(f"`{id_col}`").alias("_x_id"), F.col(f"`{text_col}`").alias("_x_text"))
    id_type = plain.schema["_x_id"].dataType.simpleString()
    w, n = word_hashes([t for _, t, _ in items], FOLD)
    ends = np.cumsum(n)
    aw, an = word_hashes([a for _, _, a in items], FOLD)
    aends = np.cumsum(an)
    parts = [Item(w[ends[i] - n[i]:ends[i]].tolist(), aw[aends[i] - an[i]:aends[i]].tolist()) for i in range(len(items))]
    table = (vectors * idf[:, None]).astype(np.float32)
    y = np.array([table[features(np.array(p.words, np.uint64))].sum(axis=0) if p.words else np.zeros(table.shape[1]) for p in parts], np.float32)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    limit = np.minimum(min_cosine, SHORT * np.sqrt(np.array([len(p.words) for p in parts]) / WINDOW)).astype(np.float32)
    plain_parts = [(p.words, p.answer) for p in parts]
    # FEATURES x RANK numbers and ITEM_BLOCK passages at most
    shared = docs.sparkSession.sparkContext.broadcast((table.astype(np.float16), y, limit, plain_parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, y, limit, plain_parts = shared.value
        table = with_zero_row(table.astype(np.float32))
        parts = [Item(*p) for p in plain_parts]
        bound, order_bound = WordBound([features(np.array(p.words, np.uint64)) for p in parts]), OrderBound([p.words for p in parts])
        names = ["_x_id", "_x_item", "cosine", "lcs", "first_word", "n_words", "answer"]
        for b in batches:
            texts = b.column(1).to_pylist()
            rows, rest = [], []
            for s, e in slices(texts):
                w, n = word_hashes(texts[s:e], FOLD)
                first_word = np.cumsum(n) - n
                x, owner, first = windows(w, n, table)
                norm = np.maximum(np.linalg.norm(x, axis=1), 1e-9)
                slot, blocks = bound.slot[features(w)], -(-n // STEP)
                block, slot = block_of(n)[slot >= 0], slot[slot >= 0]
                home = (np.cumsum(blocks) - blocks)[owner] + first // STEP
                for at in range(0, len(x), bound.passages):
                    part = slice(at, at + bound.passages)
                    cos = (x[part] @ y.T) / norm[part, None]
                    i, j = np.nonzero(cos >= limit)
                    if check:
                        ok = bound.may_match(block, slot, home[part], i, j)
                        i, j = i[ok], j[ok]
                        k, start, extra = owner[at + i], first[at + i], bound.n[j] // 2
                        lo, hi = np.maximum(0, start - extra), np.minimum(n[k], start + WINDOW + extra)
                        ok = order_bound.may_match(w, first_word[k] + lo, first_word[k] + hi, j)
                        i, j = i[ok], j[ok]
                    for i, j in zip(i.tolist(), j.tolist()):
                        item, k, start = parts[j], int(owner[at + i]), int(first[at + i])
                        if not check:
                            rows.append(s + k)
                            rest.append((j, float(cos[i, j]), 0.0, start, WINDOW, 0.0))
                            continue
                        extra = len(item.words) // 2
                        lo, hi = max(0, start - extra), min(int(n[k]), start + WINDOW + extra)
                        region = w[first_word[k] + lo:first_word[k] + hi].tolist()
                        if (m := match(item, region)) is not None:
                            rows.append(s + k)
                            rest.append((j, float(cos[i, j]), m[0], lo + m[1], m[2], m[3]))
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
            cols = [pa.array([r[c] for r in rest], kinds[c]) for c in range(6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names)

    found = plain.mapInArrow(run, f"_x_id {id_type}, _x_item int, cosine double, lcs double, first_word bigint, n_words bigint, answer double")
    ids = docs.sparkSession.createDataFrame([(k, i) for k, (i, _, _) in enumerate(items)], f"_x_item int, item {key_type}")
    return found.join(F.broadcast(ids), "_x_item").drop("_x_item")   # about ITEM_BLOCK ids


def item_passages(benchmark: DataFrame, item_col: str, item_text: str, answer_col: str | None) -> DataFrame:
    """(item, text, answer): items in overlapping passages of WINDOW words, the last one full too (shorter items are one); the answer goes with each."""
    text = F.col(f"`{item_text}`")
    answer = F.col(f"`{answer_col}`") if answer_col else last_sentence(text)
    words = F.filter(F.split(F.translate(text, PUNCTUATION, " " * len(PUNCTUATION)), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    cut = let(words, lambda w: let(F.greatest(F.size(w) - WINDOW, F.lit(0)), lambda last: F.transform(
        F.sequence(F.lit(0), F.ceil(last / ITEM_STEP).cast("int")),
        lambda i: F.array_join(F.slice(w, F.least(i * ITEM_STEP, last) + 1, WINDOW), " "))))
    return (benchmark.where(F.col(f"`{item_col}`").isNotNull() & text.isNotNull()).dropDuplicates([item_col, item_text])
            .select(F.col(f"`{item_col}`").alias("item"), F.explode(cut).alias("text"), F.coalesce(answer, F.lit("")).alias("answer"))
            .where(F.regexp_like("text", F.lit(r"[\p{L}\p{N}]"))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", answer_col: str | None = None, rank: int = RANK, min_cosine: float = MIN_COSINE, check: bool = True) -> DataFrame:
    """One row per (document, item) found: ids, ``cosine``, ``lcs`` (share of the passage's words), ``first_word``, ``n_words``, ``answer``; the best passage.

    ``check=False`` gives the candidates of the cosine search.

    Defined results: null or empty texts and items match nothing; null document ids are found like any id; items
    with a null id are left out; rows that share an id give one result; an empty benchmark or table gives no row; extra columns are ignored.
    """
    spark = docs.sparkSession
    passages = materialise(item_passages(benchmark, item_col, item_text, answer_col), "items")
    key_type = passages.schema["item"].dataType.simpleString()
    n_items, n_docs = passages.count(), docs.count()
    id_type = docs.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    schema = f"_x_id {id_type}, item {key_type}, cosine double, lcs double, first_word bigint, n_words bigint, answer double"
    found = spark.createDataFrame([], schema)
    if n_items and n_docs:
        weight = FIT_WEIGHT * (10 * n_docs / n_items) ** 0.5
        fit = text_features(docs, text_col).select("words", F.lit(1.0).alias("weight"), F.lit(False).alias("item"))
        bench = text_features(passages, "text").select("words", F.lit(float(weight)).alias("weight"), F.lit(True).alias("item"))
        fit = materialise(fit.unionByName(bench), "fit")
        idf = word_idf(fit.where(~F.col("item")))
        vectors = singular_vectors(fit, idf, rank)
        blocks = -(-n_items // ITEM_BLOCK)
        for k in range(blocks):
            rows = passages.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()   # about ITEM_BLOCK passages
            if rows:
                found = found.unionByName(search(docs, [(r.item, r.text, r.answer) for r in rows], vectors, idf, id_col, text_col, key_type, min_cosine, check))
    best = found.groupBy("_x_id", "item").agg(F.max(F.struct("lcs", "cosine", -F.col("first_word"), "n_words", "answer")).alias("m"))
    return best.select(F.col("_x_id").alias(id_col), F.col("item").alias(item_col), F.col("m.cosine"), F.col("m.lcs"),
                       (-F.col("m.col3")).alias("first_word"), F.col("m.n_words"), F.col("m.answer"))
