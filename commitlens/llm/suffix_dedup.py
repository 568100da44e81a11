"""Operator 5 - suffix-array deduplication by a prefix-aware distributed merge sort.

Bytes covered by a ``size``-byte string that starts in more than one place are removed.  A sparse
suffix array is enough for that: every window of ``size`` bytes is represented by its anchor, the
position of the smallest hash of a ``GRAM``-byte string inside (the leftmost of equal ones).  Equal windows have
their anchors at the same offset, so window (anchor, offset o) is repeated exactly when another anchor has the same o bytes
before and the same size - o bytes from it on.  About 1 in 185 suffixes is an anchor.

1. An anchor can have a repeated window only if one of its contexts (the bytes that all its windows with offsets in
   one class of ``CLASS`` have in common) occurs twice.  Hashes of contexts meet in hash blocks; most anchors end here.
2. Suffixes of the other anchors, cut after the last byte their windows need, are sorted into runs, front-coded, and exchanged by range.
   Splitters have ``GRAM`` bytes, which all members of a group share, so no group is cut; their number is bounded, and ranges are
   divided further by a hash of those bytes.
3. Each range merges its runs with a loser tree that knows how many leading bytes each
   contender shares with the last output and only compares beyond them.  The merged order comes with its LCP array, which gives
   the classes of equal right sides for every offset; left sides are told apart by a 64-bit hash that grows by one byte per offset.
4. Repeated windows go back to their documents as byte spans.

Of texts that are equal as a whole only one is sorted; all of their bytes are repeated.

Copies of one context within a map task send one record; their windows are known to be repeated there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise
from commitlens.llm.ngram_join import by_block, chunks, u64
from commitlens.llm.shingles import mix

SIZE = 400
SHARED = 300                 # bytes of a shared passage of about 50 words, which are counted and stay
GRAM = 32
CLASS = 100
PIECE = 1 << 18              # window starts handled at once
RUN_BYTES = 8 << 20          # text bytes whose suffixes form one run
BLOCK_BYTES = 8 << 20        # text bytes per hash block
RANGE_BYTES = 16 << 20       # text bytes per range of the merge
MAX_RANGES = 4096            # ranges told apart by splitters; beyond, a hash of the splitting prefix divides each range
PER_RANGE = 16               # sampled suffixes per range, for the splitters only

_rng = np.random.Generator(np.random.PCG64(7))
_TABLE = _rng.integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_R = 0xD1342543DE82EF95
_RINV = pow(_R, -1, 1 << 64)
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _power or len(_power[base]) < n:
        with np.errstate(over="ignore"):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _power[base] = np.cumprod(p, dtype=np.uint64)
    return _power[base][:n]


class Piece:
    """Bytes of several short documents, or of a part of a long one, with their anchors.

    ``anchor``: index of each anchor; ``low``, ``high``: the offsets of its windows; ``doc``: index of its
    document; ``pos``: its position there.
    """

    def __init__(self, parts: list[tuple[int, int, bytes]], size: int) -> None:
        self.data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        n = len(self.data)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[self.data] * _powers(_R, n), dtype=np.uint64)])
        ends = np.cumsum([len(p[2]) for p in parts])
        starts = ends - [len(p[2]) for p in parts]
        valid = np.concatenate([np.arange(s, e - size + 1) for s, e in zip(starts, ends) if e - s >= size] or [np.zeros(0, np.int64)])
        width = size - GRAM + 1
        if len(valid):
            with np.errstate(over="ignore"):
                grams = n - GRAM + 1
                h = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * _powers(_RINV, grams))
                key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
            rows = -(-grams // width)
            grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
            grid[:grams] = key
            grid = grid.reshape(rows, width)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            best = (np.minimum(back[valid], ahead[valid + width - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (valid[1:] != valid[:-1] + 1)]))
            last = np.append(new[1:], len(best)) - 1
            self.anchor, self.high, self.low = best[new], best[new] - valid[new], best[last] - valid[last]
        else:
            self.anchor = self.high = self.low = np.zeros(0, np.int64)
        part = np.searchsorted(ends, self.anchor, side="right")
        self.doc = np.array([p[0] for p in parts], np.int64)[part]
        self.pos = self.anchor - starts[part] + np.array([p[1] for p in parts], np.int64)[part]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * _powers(_RINV, len(self.data) + 1)[start])


def pieces(texts: list[str | None], size: int) -> Iterator[Piece]:
    parts: list[tuple[int, int, bytes]] = []
    total = 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        for at in range(0, max(0, len(b) - size + 1), PIECE):
            part = b[at:at + PIECE + size - 1]
            if total + len(part) > PIECE + size - 1 and parts:
                yield Piece(parts, size)
                parts, total = [], 0
            parts.append((i, at, part))
            total += len(part)
    if parts:
        yield Piece(parts, size)


def repeated_contexts(rows: DataFrame, size: int, bits: int) -> DataFrame:
    """(_x_key, _x_pos): anchors with a context that occurs twice or more (step 1)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, 1):
            keys = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out: dict[str, list] = {x: [] for x in ("block", "h", "key", "pos", "c_key", "c_pos")}
            for p in pieces(texts, size):
                hs, who = [], []
                for j in range(0, size, CLASS):
                    at = np.flatnonzero((p.low < j + CLASS) & (p.high >= j))
                    with np.errstate(over="ignore"):
                        hs.append(mix(p.hash(p.anchor[at] - j, p.anchor[at] - j + size - CLASS + 1) + np.uint64(j + 1)))
                    who.append(at)
                h, who = np.concatenate(hs), np.concatenate(who)
                order = np.argsort(h, kind="stable")
                h, who = h[order], who[order]
                key, pos = keys[p.doc[who]], p.pos[who].astype(np.uint64)
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(start, len(h)))
                several = np.repeat(count > 1, count)
                uh, ukey, upos = h[start], np.where(count > 1, np.uint64(0), key[start]), pos[start]
                for blk, sl in by_block(uh, bits):
                    lo, hi = start[sl.start], (start[sl.stop] if sl.stop < len(start) else len(h))
                    s = several[lo:hi]
                    for name, v in zip(out, (blk, uh[sl].tobytes(), ukey[sl].tobytes(), upos[sl].astype(np.uint32).tobytes(),
                                             key[lo:hi][s].tobytes(), pos[lo:hi][s].astype(np.uint32).tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), *[pa.array(out[x], pa.binary()) for x in list(out)[1:]]], list(out))

    def meet(t: pa.Table) -> pa.Table:
        h, key = (np.concatenate([u64(x) for x in t.column(c)]) for c in ("h", "key"))
        pos = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("pos")])
        pos = np.where(key == 0, np.uint32(0), pos)
        order = np.lexsort((pos, key, h))
        h, key, pos = h[order], key[order], pos[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
        h, key, pos = h[new], key[new], pos[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(start, len(h)))
        hit = np.repeat((count > 1) | (key[start] == 0), count) & (key != 0)
        c_key = np.concatenate([u64(x) for x in t.column("c_key")])
        c_pos = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("c_pos")])
        both = np.unique(np.stack([np.concatenate([key[hit], c_key]), np.concatenate([pos[hit], c_pos]).astype(np.uint64)], axis=1), axis=0)
        return pa.table({"_x_key": pa.array(both[:, 0].copy().view(np.int64)), "_x_pos": pa.array(both[:, 1].astype(np.int64))})

    sent = rows.mapInArrow(emit, "block int, h binary, key binary, pos binary, c_key binary, c_pos binary")
    return sent.groupBy("block").applyInArrow(meet, "_x_key bigint, _x_pos bigint")


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``at`` bytes."""
    n, step = min(len(a), len(b)), 16
    while at < n:
        end = min(n, at + step)
        if a[at:end] == b[at:end]:
            at, step = end, step * 4
        elif step == 1 or end - at == 1:
            return at
        else:
            step = max(1, (end - at) // 2)
    return n


def front_code(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(lcp with the predecessor, tails, lengths) of sorted strings."""
    lcp = np.zeros(len(strings), np.uint16)
    for i in range(1, len(strings)):
        lcp[i] = common(strings[i - 1], strings[i], 0)
    return lcp, b"".join(s[k:] for s, k in zip(strings, lcp.tolist())), np.array([len(s) for s in strings], np.uint16)


def run_reader(lcp: np.ndarray, tails: bytes, lengths: np.ndarray) -> Iterator[tuple[bytes, int]]:
    at, last = 0, b""
    for k, n in zip(lcp.tolist(), lengths.tolist()):
        last = last[:k] + tails[at:at + n - k]
        at += n - k
        yield last, k


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int]]:
    """Loser tree over front-coded runs: yields (run, LCP with the string before) in sorted order.

    ``same[i]`` is what the head of run i shares with the last output.  The contender that shares more is the smaller one; only
    on a tie are bytes compared, from there on, and the loser then remembers what it shares with the winner.
    """
    n = 1
    while n < len(runs):
        n *= 2
    head: list[bytes | None] = [None] * n
    same = [0] * n
    for i, r in enumerate(runs):
        first = next(r, None)
        head[i] = first[0] if first else None
    loser = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if same[a] != same[b]:
            return (a, b) if same[a] > same[b] else (b, a)
        k = common(x, y, same[a])
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            same[b] = k
            return a, b
        same[a] = k
        return b, a

    level = list(range(n))
    at = n // 2
    while len(level) > 1:
        winners = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            winners.append(w)
            loser[at + i // 2] = lost
        level, at = winners, at // 2
    win = level[0]
    while head[win] is not None:
        yield win, same[win]
        nxt = next(runs[win], None) if win < len(runs) else None
        head[win], same[win] = nxt if nxt else (None, 0)
        node = (win + n) // 2
        while node >= 1:
            win, loser[node] = play(win, loser[node])
            node //= 2


def spans_of(key: int, pos: int, low: int, good: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """(key, start, end) byte spans of the repeated windows at offsets low + i where good[i]."""
    edge = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
    return [(key, pos - (low + int(e) - 1), pos - (low + int(s)) + size) for s, e in zip(edge[::2], edge[1::2])]


FIELDS = {"key": np.int64, "pos": np.int64, "low": np.uint16, "high": np.uint16}


def sorted_runs(rows: DataFrame, splitters: list[bytes], size: int, divide: int = 1) -> DataFrame:
    """(_x_key, text, _x_at) -> front-coded sorted runs by range (range >= 0), and spans already known (range -1).

    Each range between splitters is divided into ``divide`` runs by a hash of the first GRAM bytes, which equal windows share.
    """
    cut = np.array(splitters, dtype=object)
    shared = rows.sparkSession.sparkContext.broadcast(cut)   # GRAM bytes per range, MAX_RANGES at most

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["range", "lcp", "tails", "length", *FIELDS, "left", "spans"]
        for b, texts in chunks(batches, 1, RUN_BYTES):
            keys, wanted = b.column(0).to_pylist(), b.column(2)
            records: dict[tuple[bytes, bytes, int, int], list[tuple[int, int]]] = {}
            for p in pieces(texts, size):
                for d in np.unique(p.doc).tolist():
                    mine = np.arange(np.searchsorted(p.doc, d), np.searchsorted(p.doc, d, side="right"))
                    mine = mine[np.isin(p.pos[mine], np.array(wanted[d].as_py(), np.int64))]
                    for i in mine.tolist():
                        a, lo, hi = int(p.anchor[i]), int(p.low[i]), int(p.high[i])
                        left, right = p.data[a - hi:a].tobytes(), p.data[a:a + size - lo].tobytes()
                        records.setdefault((right, left, lo, hi), []).append((keys[d], int(p.pos[i])))
            order = sorted(records)
            prefix = np.array([r[0][:GRAM] for r in order] + [b""], dtype=object)[:-1]
            ranges = np.searchsorted(shared.value, prefix, side="right").astype(np.int64) if order else np.zeros(0, np.int64)
            ranges = ranges * divide + np.array([zlib.crc32(x) % divide for x in prefix], np.int64)
            out: dict[str, list] = {x: [] for x in names}
            for g in np.unique(ranges).tolist():
                part = [order[i] for i in np.flatnonzero(ranges == g).tolist()]
                lcp, tails, length = front_code([r[0] for r in part])
                own = [records[r][0] for r in part]
                cols = {"key": [k for k, _ in own], "pos": [x for _, x in own], "low": [r[2] for r in part], "high": [r[3] for r in part]}
                for name, v in zip(names, (g, lcp.tobytes(), tails, length.tobytes(), *[np.array(cols[c], t).tobytes() for c, t in FIELDS.items()],
                                           b"".join(r[1] for r in part), b"")):
                    out[name].append(v)
            known = [s for r, owners in records.items() if len(set(owners)) > 1 for k, x in set(owners)
                     for s in spans_of(k, x, r[2], np.ones(r[3] - r[2] + 1, bool), size)]
            if known:
                for name, v in zip(names, (-1, *[b""] * (len(names) - 2), np.array(known, np.int64).tobytes())):
                    out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["range"], pa.int32()), *[pa.array(out[x], pa.binary()) for x in names[1:]]], names)

    schema = "range int, lcp binary, tails binary, length binary, key binary, pos binary, low binary, high binary, left binary, spans binary"
    return rows.mapInArrow(emit, schema)


def merged_spans(runs: DataFrame, size: int) -> DataFrame:
    """(_x_key, start, end) spans of repeated windows found in each range (step 3)."""
    def merge(t: pa.Table) -> pa.Table:
        get = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in t.column(c)]
        lcp, length, tails = get("lcp", np.uint16), get("length", np.uint16), t.column("tails").to_pylist()
        cols = {c: get(c, kind) for c, kind in FIELDS.items()}
        lefts = []
        for blob, high in zip(get("left", np.uint8), cols["high"]):     # right-aligned rows of size bytes
            m = np.zeros((len(high), size), np.uint8)
            m[np.arange(size)[None, :] >= (size - high.astype(np.int64))[:, None]] = blob
            lefts.append(m)
        base = np.cumsum([0, *[len(x) for x in lcp]])
        taken, order, depth = [0] * len(lcp), [], []
        for r, k in merge_runs([run_reader(*x) for x in zip(lcp, tails, length)]):
            order.append(int(base[r]) + taken[r])
            depth.append(k)
            taken[r] += 1
        order, depth = np.array(order, np.int64), np.array(depth, np.int64)
        key, pos, low, high = (np.concatenate(cols[c])[order] for c in FIELDS)
        low, high = low.astype(np.int64), high.astype(np.int64)
        left = np.concatenate(lefts)[order]
        good = np.zeros((len(order), size), bool)
        h = np.zeros(len(order), np.uint64)
        with np.errstate(over="ignore"):
            for o in range(0, int(high.max(initial=-1)) + 1):
                if o:
                    h += np.where(high >= o, _TABLE[left[:, size - o]] * _powers(_R, size + 1)[o], np.uint64(0))
                at = np.flatnonzero((low <= o) & (o <= high))
                group = np.cumsum(depth < size - o)[at]
                c = mix(h[at] + mix(group.astype(np.uint64) + np.uint64(1)))
                by = np.argsort(c, kind="stable")
                eq = c[by][1:] == c[by][:-1]
                twice = np.zeros(len(at), bool)
                twice[1:] |= eq
                twice[:-1] |= eq
                good[at[by[twice]], o] = True
        found = [s for i in np.flatnonzero(good.any(axis=1)).tolist()
                 for s in spans_of(int(key[i]), int(pos[i]), int(low[i]), good[i, low[i]:high[i] + 1], size)]
        return pa.table({n: pa.array([s[j] for s in found], pa.int64()) for j, n in enumerate(("_x_key", "start", "end"))})

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                s = np.frombuffer(x.as_py(), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(s[:, j].copy()) for j in range(3)], ["_x_key", "start", "end"])

    schema = "_x_key bigint, start bigint, end bigint"
    merged = runs.where("range >= 0").drop("spans").groupBy("range").applyInArrow(merge, schema)
    return merged.unionByName(runs.where("range < 0").select("spans").mapInArrow(known, schema))


def splitters(rows: DataFrame, size: int, ranges: int, n_rows: int) -> list[bytes]:
    """Range bounds from the anchors of a sample of documents (the result does not depend on them)."""
    part = max(1, min(1 << 30, int((1 << 30) * ranges * PER_RANGE / max(1, 4 * n_rows))))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 1):
            for p in pieces(texts, size):
                pick = p.anchor[:: max(1, len(p.anchor) // 256)]
                yield pa.RecordBatch.from_arrays([pa.array([p.data[a:a + GRAM].tobytes() for a in pick.tolist()], pa.binary())], ["g"])

    some = rows.where(F.pmod(F.xxhash64("_x_key", F.lit(3)), F.lit(1 << 30)) < part).mapInArrow(emit, "g binary")
    got = sorted({bytes(r.g) for r in some.limit(ranges * PER_RANGE).collect()})
    return [got[len(got) * i // ranges] for i in range(1, ranges)] if len(got) >= ranges else got


def whole_copies(rows: DataFrame) -> DataFrame:
    """(_x_c, _x_n, _x_first): texts that stand under several keys, their length in bytes, and whether the key is the smallest of them.

    Every byte of such a text is repeated, so only the first copy is sorted, as a partner for other texts.
    """
    text = F.col("text")
    one = rows.select("_x_key", F.octet_length(text).cast("long").alias("n"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(11), text).alias("h2")).distinct()
    same = one.groupBy("h", "h2", "n").agg(F.count(F.lit(1)).alias("c"), F.min("_x_key").alias("first")).where("c > 1")
    same = same.withColumnsRenamed({"h": "g", "h2": "g2", "n": "gn"})
    both = F.struct(*[F.col(c).alias(k) for c, k in (("h", "a"), ("h2", "b"), ("n", "c"))]) == F.struct(*[F.col(c).alias(k) for c, k in (("g", "a"), ("g2", "b"), ("gn", "c"))])
    return one.join(same, both).select(F.col("_x_key").alias("_x_c"), F.col("n").alias("_x_n"), (F.col("_x_key") == F.col("first")).alias("_x_first"))


def with_copies(spans: DataFrame, copies: DataFrame, size: int) -> DataFrame:
    """Spans of all texts: one whole span for each copy of at least ``size`` bytes."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("_x_n").alias("end")))
    return (spans.join(copies, F.col("_x_k") == F.col("_x_c"), "left_anti")
            .unionByName(copies.where(F.col("_x_n") >= size).select(F.col("_x_c").alias("_x_k"), whole.alias("_x_spans"))))


def repeat_spans(rows: DataFrame, size: int, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((_x_k, _x_spans): byte spans covered by ``size``-byte strings that start twice; (_x_key, text): texts with a repeated context).

    Rows that agree in ``_x_key`` are one text.  Every text with a span is among the second table's, of ``copies`` the first.
    """
    rows = rows.where(F.octet_length("text") >= size)
    total, n_rows = rows.select(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    bits = max(6, int(np.ceil(np.log2(max(1, (total or 0) / BLOCK_BYTES)))))
    ranges = max(24, -(-(total or 0) // RANGE_BYTES))
    wanted = (repeated_contexts(rows, size, bits).groupBy("_x_key").agg(F.collect_set("_x_pos").alias("_x_at")).withColumnRenamed("_x_key", "_x_k"))
    wanted = wanted.join(copies.where(~F.col("_x_first")), F.col("_x_k") == F.col("_x_c"), "left_anti")
    # the join has dealt rows by key: repeated rows become one where they are
    hot = materialise(rows.join(wanted, F.col("_x_key") == F.col("_x_k")).select("_x_key", "text", "_x_at").dropDuplicates(["_x_key"]), "hot-texts")
    coarse = min(ranges, MAX_RANGES)
    runs = materialise(sorted_runs(hot, splitters(rows, size, coarse, n_rows), size, -(-ranges // coarse)), "runs")
    spans = merged_spans(runs, size).groupBy("_x_key").agg(F.collect_set(F.struct("start", "end")).alias("_x_spans"))
    return with_copies(spans.withColumnRenamed("_x_key", "_x_k"), copies, size), hot.select("_x_key", "text")


def joined_spans(spans: list[dict[str, int]] | None) -> list[dict[str, int]]:
    """Maximal runs of the bytes in (start, end) spans that may overlap."""
    out: list[dict[str, int]] = []
    for x in sorted(spans or [], key=lambda x: x["start"]):
        if out and x["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], x["end"])
        else:
            out.append(dict(x))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, shared: int | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, spans (array of start, end: removed bytes) and kept (binary).

    With ``shared`` (a smaller size) also ``n_shared``: bytes in strings of that size that start elsewhere too.  They are only counted.
    Defined results: a null text is empty; texts shorter than ``size`` bytes lose nothing; rows that agree
    in id and text are one document and get the same result; rows that share an id but not the text are different
    documents; null ids are like any id; extra columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = docs.select(F.col(f"`{id_col}`").alias("_x_id"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), text).alias("_x_key"), text.alias("text"))
    rows = base.select("_x_key", "text")
    copies = materialise(whole_copies(rows), "whole-copies")
    if shared:     # longer repeats stand only in texts with shorter ones
        short, rows = repeat_spans(rows, min(shared, size), copies)
        short = materialise(short.withColumnRenamed("_x_spans", "_x_short"), "short-spans")
        spans = short.join(repeat_spans(rows, size, copies)[0], "_x_k", "left")
    else:
        spans = repeat_spans(rows, size, copies)[0].withColumn("_x_short", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    id_type = base.schema["_x_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches, 1):
            n, spans_out, kept, short = [], [], [], []
            for t, s, few in zip(texts, b.column(2), b.column(3)):
                data = t.encode("utf-8", "surrogatepass")
                whole = joined_spans(s.as_py())
                short.append(sum(x["end"] - x["start"] for x in joined_spans(few.as_py())))
                at = [0, *[v for x in whole for v in (x["start"], x["end"])], len(data)]
                n.append(len(data))
                spans_out.append(whole)
                kept.append(b"".join(data[i:j] for i, j in zip(at[::2], at[1::2])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans_out, kind), pa.array(kept, pa.binary()),
                                              pa.array(short, pa.int64())], ["_x_id", "n_bytes", "spans", "kept", "n_shared"])

    joined = base.join(spans, F.col("_x_key") == F.col("_x_k"), "left").select("_x_id", "text", "_x_spans", "_x_short")
    out = joined.mapInArrow(cut, f"_x_id {id_type}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary, n_shared bigint")
    return (out if shared else out.drop("n_shared")).withColumnRenamed("_x_id", id_col)
