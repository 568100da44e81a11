"""Operator 4 - n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets (documents with the same set
are one row), columns are shingles, both in blocks.  The product is never
formed in full; bounds that follow from the set sizes leave out what cannot reach the threshold:

1. In hash order, linked sets of sizes x and y share at least l of the first n - ceil(t n) + l
   shingles of either (l-prefix).  Column blocks of these prefixes tell how many of a row's prefix
   entries occur in another row; rows under the bound are out.
2. Column blocks of the remaining rows give document frequencies.  A row needs ceil(t n) entries that another row has.
   In order of rarity, linked rows meet in a column of their first n - ceil(t n) + 1 entries (prefix postings).
3. Overlaps are summed for two rounds of pairs: each row of a posting with the most central one (fewest entries of
   its own), then, for postings that still hold several components, pairs across components
   that pass the size and position bounds.  Pairs inside a component add nothing to the result, so groups
   of near copies cost about one product per row, not one per pair.
4. Components come from large-star/small-star rounds.

Row and column ids are 64-bit hashes; at 3e10 documents some tens of set ids are expected to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise, row_key, skew_join
from commitlens.llm.components import connected_components
from commitlens.llm.shingles import set_ids, shingle_sets

K, PCT = 4, 85
EXTRA_PCT = 10               # l of the l-prefix, in per cent of the set size
BLOCK_BYTES = 8 << 20        # text bytes per column block
CHUNK_BYTES = 2 << 20        # text bytes hashed together: one block of rows


def share(n, pct: int):
    """ceil(pct * n / 100) for integers, arrays or columns."""
    return F.floor((n * pct + 99) / 100) if isinstance(n, Column) else (n * pct + 99) // 100


def block_bits(text_bytes: int) -> int:
    return max(6, int(np.ceil(np.log2(max(1, text_bytes / BLOCK_BYTES)))))


def chunks(batches: Iterator[pa.RecordBatch], text: int, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of the batches with about ``size`` bytes of text; only one slice at a time becomes Python strings."""
    import pyarrow.compute as pc

    for b in batches:
        group = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                part = b.slice(s, e - s)
                yield part, part.column(text).to_pylist()


def document_sets(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(_x_id, _x_rk, sid, n): each row's set id and size."""
    plain = docs.select(F.col(f"`{id_col}`").alias("_x_id"), row_key(F.col(f"`{text_col}`")).alias("_x_rk"), F.col(f"`{text_col}`").alias("_x_text"))
    id_type = plain.schema["_x_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 2):
            h, n = shingle_sets(texts, k)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_ids(h, n).view(np.int64)), pa.array(n)], ["_x_id", "_x_rk", "sid", "n"])

    return plain.mapInArrow(run, f"_x_id {id_type}, _x_rk bigint, sid bigint, n bigint")


def by_block(h: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Slices of rising hashes by their leading bits."""
    block = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(block, prepend=-1))
    return [(int(block[s]), slice(s, e)) for s, e in zip(cuts, [*cuts[1:], len(h)])]


def u64(x: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(x.as_py() if isinstance(x, pa.Scalar) else x, np.uint64)


def prefix_counts(docs: DataFrame, text_col: str, k: int, pct: int, bits: int) -> DataFrame:
    """(sid, shared): entries of the row's l-prefix that some other row's l-prefix has (step 1).

    A shingle that several rows of one chunk have is credited to them at once and sent as a single marked entry, so a hot
    column has one entry per chunk at most.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches, 0):
            h, n = shingle_sets(texts, k)
            sid = set_ids(h, n)
            place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            keep = place < np.repeat(n - share(n, pct) + share(n, EXTRA_PCT), n)
            h, own = h[keep], np.repeat(sid, n)[keep]
            order = np.lexsort((own, h))
            h, own = h[order], own[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
            h, own = h[new], own[new]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(h)))
            several = np.repeat(count > 1, count)
            uh, uown = h[start], np.where(count > 1, np.uint64(0), own[start])
            rows: dict[str, list] = {"block": [], "h": [], "own": [], "c_own": [], "c_n": []}
            for b, sl in by_block(uh, bits):
                lo, hi = start[sl.start], (start[sl.stop] if sl.stop < len(start) else len(h))
                c_own, c_n = np.unique(own[lo:hi][several[lo:hi]], return_counts=True)
                for name, v in zip(rows, (b, uh[sl].tobytes(), uown[sl].tobytes(), c_own.tobytes(), c_n.astype(np.uint64).tobytes())):
                    rows[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows["block"], pa.int32()), *[pa.array(rows[x], pa.binary()) for x in ("h", "own", "c_own", "c_n")]], list(rows))

    def meet(t: pa.Table) -> pa.Table:
        h, own = (np.concatenate([u64(x) for x in t.column(c)]) for c in ("h", "own"))
        order = np.lexsort((own, h))
        h, own = h[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        h, own = h[new], own[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(start, len(h)))
        hit = np.repeat((count > 1) | (own[start] == 0), count) & (own != 0)   # 0 sorts first and stands for several rows
        c_own, c_n = (np.concatenate([u64(x) for x in t.column(c)]) for c in ("c_own", "c_n"))
        sid, at = np.unique(np.concatenate([own[hit], c_own]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([np.ones(int(hit.sum())), c_n.astype(float)]), minlength=len(sid))
        return pa.table({"sid": pa.array(sid.view(np.int64)), "shared": pa.array(n.astype(np.int64))})

    entries = docs.select(F.col(f"`{text_col}`").alias("_x_text")).mapInArrow(emit, "block int, h binary, own binary, c_own binary, c_n binary")
    found = entries.groupBy("block").applyInArrow(meet, "sid bigint, shared bigint")
    return found.groupBy("sid").agg(F.sum("shared").alias("shared"))


ROW_CHUNK = "chunk bigint, sid array<bigint>, n array<bigint>, h binary"


def row_chunks(texts: DataFrame, k: int) -> DataFrame:
    """(sid, text), one row per sid -> blocks of rows with their sets; a block's key is a hash of its sids in order, so no two share one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in chunks(batches, 1):
            h, n = shingle_sets(values, k)
            sid = part.column(0).to_numpy(zero_copy_only=False)
            chunk = int.from_bytes(hashlib.blake2b(sid.tobytes(), digest_size=8).digest(), "big", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sid.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64())),
                                              pa.array([h.tobytes()], pa.binary())], ["chunk", "sid", "n", "h"])

    return texts.select("sid", "text").mapInArrow(run, ROW_CHUNK)


def frequencies(rows: DataFrame, bits: int) -> DataFrame:
    """(chunk, parts): for each chunk the frequency class of its distinct shingles, in rising hash order, by column block.

    Classes are rounded logarithms in one byte (0: one row only); all that matters is that every row sees the
    same class for a shingle.  A shingle is sent once per chunk with its count there.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"block": [], "chunk": [], "h": [], "c": []}
            for i in range(b.num_rows):
                h, c = np.unique(u64(b.column(3)[i]), return_counts=True)
                for blk, sl in by_block(h, bits):
                    for name, v in zip(out, (blk, b.column(0)[i].as_py(), h[sl].tobytes(), c[sl].astype(np.uint32).tobytes())):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), pa.array(out["chunk"], pa.int64()), pa.array(out["h"], pa.binary()), pa.array(out["c"], pa.binary())], list(out))

    def count(t: pa.Table) -> pa.Table:
        parts = [u64(x) for x in t.column("h")]
        c = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("c")])
        u, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(at, weights=c)
        rank = np.minimum(255, np.ceil(6 * np.log2(df))).astype(np.uint8)[at]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table({"chunk": t.column("chunk"), "block": t.column("block"), "rank": pa.array([rank[e - len(p):e].tobytes() for e, p in zip(ends, parts)], pa.binary())})

    sent = rows.select("chunk", "sid", "n", "h").mapInArrow(emit, "block int, chunk bigint, h binary, c binary")
    ranks = sent.groupBy("block").applyInArrow(count, "chunk bigint, block int, rank binary")
    return ranks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("block", "rank"))).alias("parts"))


def prefix_rows(rows: DataFrame, ranks: DataFrame, pct: int) -> DataFrame:
    """(sid, n, shared, h, post): rows that pass the bound of step 2, with their postings (h, r): shingle and its place by rarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sid, n, h = (b.column(0)[i].as_py(), np.array(b.column(1)[i].as_py(), np.int64), u64(b.column(2)[i]))
                rank = np.frombuffer(b"".join(x["rank"] for x in b.column(3)[i].as_py() or []), np.uint8)
                df = rank[np.searchsorted(np.unique(h), h)]
                own = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, df, own))
                place = np.arange(len(h)) - (np.cumsum(n) - n)[own]
                shared = np.bincount(own[df > 0], minlength=len(n))
                alive = (shared >= share(n, pct)) & (n > 0)
                pick = alive[own] & (place < (n - share(n, pct) + 1)[own]) & (df[order] > 0)
                out: dict[str, list] = {"sid": [], "n": [], "shared": [], "h": [], "post": []}
                for j in np.flatnonzero(alive):
                    sl = slice(int(n[:j].sum()), int(n[:j + 1].sum()))
                    r = np.flatnonzero(pick[sl])
                    post = [{"h": x, "r": y} for x, y in zip(h[order][sl][r].view(np.int64).tolist(), r.tolist())]
                    for name, v in zip(out, (sid[j], int(n[j]), int(shared[j]), h[sl].view(np.int64), post)):
                        out[name].append(v)
                kind = pa.list_(pa.struct([("h", pa.int64()), ("r", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(out["sid"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["shared"], pa.int64()),
                                                  pa.array(out["h"], pa.list_(pa.int64())), pa.array(out["post"], kind)], list(out))

    both = rows.join(ranks.withColumnRenamed("chunk", "_x_c"), F.col("chunk") == F.col("_x_c")).select("sid", "n", "h", "parts")
    return both.mapInArrow(run, "sid bigint, n bigint, shared bigint, h array<bigint>, post array<struct<h:bigint,r:bigint>>")


def need(a, b, pct: int):
    """Least overlap of linked sets of sizes a and b: ceil(pct (a + b) / (100 + pct))."""
    return F.ceil(pct * (a + b) / F.lit(100 + pct) - 1e-9)


def close(a, b, pct: int):
    return 100 * F.least(a, b) >= pct * F.greatest(a, b)


def linked(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Pairs (a, b) whose exact overlap reaches the threshold."""
    one = sets.select(F.col("sid").alias("a"), F.col("h").alias("_x_ha"))
    two = sets.select(F.col("sid").alias("b"), F.col("h").alias("_x_hb"))
    full = skew_join(skew_join(pairs, one, ["a"]), two, ["b"])
    both = F.size(F.array_intersect("_x_ha", "_x_hb"))
    return full.where(100 * both >= pct * (F.size("_x_ha") + F.size("_x_hb") - both)).select("a", "b")


def set_components(sets: DataFrame, pct: int) -> DataFrame:
    """(node, root) for all sets that have a link (steps 3 and 4)."""
    posts = materialise(sets.select("sid", "n", "shared", F.inline("post")), "postings")
    centre = (posts.groupBy("h").agg(F.count(F.lit(1)).alias("_x_m"), F.min("n").alias("_x_min"),
                                     F.max_by(F.struct("sid", "n", "r"), F.struct(F.col("shared") / F.col("n"), -F.col("sid"))).alias("_x_p"))
              .where("_x_m > 1"))
    meet = skew_join(posts, centre, ["h"])
    room = lambda n, r, n2, r2: 1 + F.least(n - r - 1, n2 - r2 - 1) >= need(n, n2, pct)
    star = (meet.where((F.col("sid") != F.col("_x_p.sid")) & close(F.col("n"), F.col("_x_p.n"), pct)
                       & room(F.col("n"), F.col("r"), F.col("_x_p.n"), F.col("_x_p.r")))
            .select(F.col("sid").alias("a"), F.col("_x_p.sid").alias("b")).distinct())
    first = connected_components(linked(star, sets, pct))
    named = posts.join(first.withColumnRenamed("node", "_x_node"), F.col("sid") == F.col("_x_node"), "left")
    named = named.select("sid", "n", "r", "h", F.coalesce("root", "sid").alias("root"))
    open_ = named.groupBy("h").agg(F.min("root").alias("_x_lo"), F.max("root").alias("_x_hi"), F.min("n").alias("_x_min")).where("_x_lo <> _x_hi")
    lead = skew_join(centre.select("h", F.col("_x_p.sid").alias("_x_c")), open_, ["h"])
    lead = lead.join(first.withColumnRenamed("root", "_x_main"), F.col("_x_c") == F.col("node"), "left").select(
        "h", "_x_min", F.coalesce("_x_main", "_x_c").alias("_x_main"))
    alive = skew_join(named, lead, ["h"])
    floor = F.greatest(F.col("_x_min"), F.ceil(F.col("n") * pct / 100 - 1e-9))
    alive = materialise(alive.where(F.col("n") - F.col("r") >= need(F.col("n"), floor, pct)), "postings")
    left = alive.where("root <> _x_main")
    right = alive.select(*[F.col(c).alias(f"_x2_{c}") for c in ("sid", "n", "r", "h", "root", "_x_main")])
    cross = left.join(right, (F.struct("h") == F.struct(F.col("_x2_h").alias("h"))) & (F.col("root") != F.col("_x2_root"))
                      & ((F.col("_x2_root") == F.col("_x2__x_main")) | (F.col("sid") < F.col("_x2_sid")))
                      & close(F.col("n"), F.col("_x2_n"), pct) & room(F.col("n"), F.col("r"), F.col("_x2_n"), F.col("_x2_r")))
    more = linked(cross.select(F.col("sid").alias("a"), F.col("_x2_sid").alias("b")).distinct(), sets, pct)
    root = lambda side: F.coalesce(F.col(f"_x_root_{side}"), F.col(side))
    for side in ("a", "b"):
        more = more.join(first.select(F.col("node").alias(f"_x_node_{side}"), F.col("root").alias(f"_x_root_{side}")), F.col(side) == F.col(f"_x_node_{side}"), "left")
    second = connected_components(more.select(root("a").alias("a"), root("b").alias("b")))
    every = first.unionByName(second.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    joined = every.join(second.select(F.col("node").alias("_x_n"), F.col("root").alias("_x_r")), F.col("root") == F.col("_x_n"), "left")
    return joined.select("node", F.coalesce("_x_r", "root").alias("root"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, pct: int = PCT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links, itself included).

    Defined results: a null text or one without words has no shingles and no links; fewer than ``k`` words are one
    shingle; rows with a null id get the smallest id of their component, but link only through texts that a
    row with an id has too, and add no id; rows that repeat an id are all its texts and link by each; repeated
    rows repeat; extra columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    bits = block_bits(docs.select(F.sum(F.octet_length(text))).first()[0] or 0)
    known = materialise(document_sets(docs, id_col, text_col, k), "sets")
    shared = prefix_counts(docs, text_col, k, pct, bits)
    firsts = (known.where(F.col("_x_id").isNotNull() & (F.col("n") > 0)).groupBy("sid", "n").agg(F.min(F.struct("_x_id", "_x_rk")).alias("_x_f")))
    passed = (firsts.join(shared.withColumnRenamed("sid", "_x_s"), F.col("sid") == F.col("_x_s"))
              .where(F.col("shared") >= share(share(F.col("n"), pct), EXTRA_PCT))
              .select("sid", F.col("_x_f._x_id").alias("_x_fid"), F.col("_x_f._x_rk").alias("_x_frk")))
    # repeated rows become one here, before the exchange that the join needs anyway
    texts = docs.select(F.col(f"`{id_col}`").alias("_x_id"), row_key(text).alias("_x_rk"), text.alias("text")).where("_x_id is not null and text is not null")
    texts = texts.dropDuplicates(["_x_id", "_x_rk"])
    texts = texts.join(passed, (F.col("_x_id") == F.col("_x_fid")) & (F.col("_x_rk") == F.col("_x_frk"))).select("sid", "text")
    rows = materialise(row_chunks(texts, k), "rows")
    sets = materialise(prefix_rows(rows, frequencies(rows, bits), pct).dropDuplicates(["sid"]), "prefixes")
    roots = materialise(set_components(sets, pct), "components")
    node = known.join(roots.withColumnRenamed("node", "_x_n"), F.col("sid") == F.col("_x_n"), "left")
    node = node.select("_x_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "sid")).alias("_x_root"))
    best = node.where("_x_root is not null").groupBy("_x_root").agg(F.min("_x_id").alias("_x_best"))
    out = skew_join(node, best, ["_x_root"], "left")
    return out.select(F.col("_x_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("_x_best", "_x_id").alias("component_id"))
