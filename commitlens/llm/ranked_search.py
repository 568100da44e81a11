"""Operator 12 - ranked lexical search of many items at once with shared partial sums.

The score of a document for an item is a sum over the item's terms, so items that share terms share parts of
their sums.  Per block of items the shared term sets are mined:

* terms that stand in the same items form one set;
* of the sets, pairs that stand together in at least two items become a new set, the most frequent first, and
  again until no pair is left.

The sets form a graph in which every set is the sum of two others.  Within a task each set's accumulator is
computed once for a batch of documents (documents as columns of one matrix), sets from their two parts, items from the
few sets that are left to them; only the best rows of a task leave it.

Texts are read once, whatever the number of items: a table with the length of each document and its query terms as
64-bit hashes is written, and each block of items reads that.  A bit map of fixed size tells query terms from others
(a false positive is dropped by the join on the hash).  Statistics (documents, terms, document frequencies) come from all documents.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import materialise
from commitlens.llm.tokens import slices, words

TOP = 50
NORM = 50                # share of the length norm in per cent
SATURATION = 20          # term saturation in thousandths, per point of the length norm
ITEM_BLOCK = 512         # items in a block, about
TERM_BLOCK = 1 << 16     # (item, term) pairs in a block, about
MAP_BITS = 1 << 24       # bits of the map of query terms (2 MB)
CELLS = 1 << 22          # numbers of an accumulator matrix
SALTS = 64


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(_x_q, _x_item, _x_term): each item's distinct terms; rows that repeat id and text are one item."""
    key = F.xxhash64(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`"))
    rows = items.select(F.col(f"`{item_id}`").alias("_x_item"), F.col(f"`{item_text}`").alias("_x_text"), key.alias("_x_q")).dropDuplicates(["_x_q"])
    rows = rows.select("_x_q", "_x_item", "_x_text")
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_x_text"]).add("_x_term", "long")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            terms = [[term_hash(w) for w in set(words(t))] for t in batch.column("_x_text").to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))
            flat = pa.array([h for t in terms for h in t], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_x_q").take(owner), batch.column("_x_item").take(owner), flat], names=["_x_q", "_x_item", "_x_term"])

    return rows.mapInArrow(split, schema)


def term_map(terms: DataFrame) -> np.ndarray:
    """Bit map of fixed size over the hashes of all query terms."""
    place = F.expr(f"pmod(_x_term, {MAP_BITS})")
    bits = terms.groupBy((place - place % 64).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(_x_term, {MAP_BITS}) % 64 as int))")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for r in bits.toLocalIterator():       # at most MAP_BITS / 64 rows
        out[r["at"] // 64] = r["bits"]
    return out.view(np.uint64)


def document_terms(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray) -> DataFrame:
    """(_x_id, _x_n, _x_terms, _x_tf): each document with a term: its length, and its query terms with their counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [words(t) for t in batch.column("_x_text").to_pylist()]
            counts = [Counter(w) for w in each]
            size = np.array([len(c) for c in counts], np.int64)
            h = np.array([term_hash(w) for c in counts for w in c], np.int64)
            tf = np.array([n for c in counts for n in c.values()], np.int64)
            at = (h % MAP_BITS).astype(np.uint64)
            known = (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            ends = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(size)])].astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [batch.column("_x_id"), pa.array([len(w) for w in each], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[known])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(tf[known]))], names=["_x_id", "_x_n", "_x_terms", "_x_tf"])
            yield out.filter(pa.array([bool(w) for w in each], pa.bool_()))

    rows = docs.select(F.col(f"`{id_col}`").alias("_x_id"), F.col(f"`{text_col}`").alias("_x_text"))
    schema = T.StructType([rows.schema["_x_id"]]).add("_x_n", "long").add("_x_terms", T.ArrayType(T.LongType())).add("_x_tf", T.ArrayType(T.LongType()))
    return rows.mapInArrow(count, schema)


@dataclass
class Sharing:
    """The query-sharing graph of a block: terms -> sets -> sums of two sets -> items."""
    terms: np.ndarray                                # hashes, rising
    weight: np.ndarray                               # per term
    leaf: np.ndarray                                 # set of each term
    rounds: list[tuple[np.ndarray, np.ndarray]]      # sums made in a round: their two parts; numbered on from the leaves
    items: list[np.ndarray]                          # sets left to each item
    n_sets: int


def share(item_of: np.ndarray, term: np.ndarray, weight: np.ndarray, n_items: int) -> Sharing:
    """Mine the shared sets of a block from its (item, term, weight) rows."""
    terms, first, place = np.unique(term, return_index=True, return_inverse=True)
    holders: list[list[int]] = [[] for _ in terms]
    for i, t in sorted(zip(item_of.tolist(), place.tolist())):
        holders[t].append(i)
    number: dict[tuple[int, ...], int] = {}
    leaf = np.array([number.setdefault(tuple(h), len(number)) for h in holders], np.int64)
    members: list[set[int]] = [set() for _ in range(n_items)]
    for h, s in number.items():
        for i in h:
            members[i].add(s)
    sets, rounds = len(number), []
    while True:
        often = Counter(s for m in members for s in m)
        pairs: Counter[tuple[int, int]] = Counter()
        for m in members:                            # neighbours in the order of frequency: linear in the item's size
            order = sorted((s for s in m if often[s] > 1), key=lambda s: (-often[s], s))
            pairs.update(zip(order, order[1:]))
        used: set[int] = set()
        chosen: dict[int, tuple[int, int]] = {}      # first part -> (second part, new set)
        for (a, b), n in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if n > 1 and a not in used and b not in used:
                used |= {a, b}
                chosen[a] = (b, sets + len(chosen))
        if not chosen:
            break
        for m in members:
            for a in [s for s in m if s in chosen and chosen[s][0] in m]:
                m -= {a, chosen[a][0]}
                m.add(chosen[a][1])
        rounds.append((np.array(list(chosen)), np.array([b for b, _ in chosen.values()])))
        sets += len(chosen)
    return Sharing(terms, weight[first], leaf, rounds, [np.array(sorted(m), np.int64) for m in members], sets)


def accumulate(g: Sharing, owner: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Accumulators of all sets (rows) for a batch of documents (columns); m is the length norm of each document."""
    at = np.minimum(np.searchsorted(g.terms, term), len(g.terms) - 1)
    known = g.terms[at] == term
    at, owner, tf = at[known], owner[known], tf[known]
    acc = np.zeros((g.n_sets, len(m)), np.int64)
    np.add.at(acc, (g.leaf[at], owner), g.weight[at] * (1_000_000_000 * tf // (1000 * tf + SATURATION * m[owner])))
    made = g.n_sets - sum(len(a) for a, _ in g.rounds)
    for a, b in g.rounds:
        np.add(acc[a], acc[b], out=acc[made:made + len(a)])
        made += len(a)
    return acc


def search_block(docs: DataFrame, g: Sharing, keys: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(_x_q, _x_id, _x_score): the ``top`` best documents of each item within each task."""
    width = max(16, CELLS // max(1, g.n_sets))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = [[] for _ in keys]
        least = np.zeros(len(keys), np.int64)        # a score below can not come in any more
        id_type = None
        for whole in batches:
            id_type = whole.schema.field("_x_id").type
            for begin in range(0, whole.num_rows, width):
                batch = whole.slice(begin, width)
                size = batch.column("_x_terms").value_lengths().to_numpy(zero_copy_only=False)
                m = 100 - NORM + NORM * batch.column("_x_n").to_numpy() * n_docs // n_terms
                acc = accumulate(g, np.repeat(np.arange(batch.num_rows), size), batch.column("_x_terms").flatten().to_numpy(zero_copy_only=False),
                                 batch.column("_x_tf").flatten().to_numpy(zero_copy_only=False), m)
                ids = batch.column("_x_id").to_pylist()
                for q, sets in enumerate(g.items):
                    score = acc[sets].sum(axis=0)
                    fit = np.flatnonzero((score > 0) & (score >= least[q]))
                    if len(fit):
                        held[q] = heapq.nsmallest(top, held[q] + list(zip((-score[fit]).tolist(), [ids[i] for i in fit])))
                        least[q] = -held[q][-1][0] if len(held[q]) == top else 0
        rows = [(keys[q], d, -s) for q, found in enumerate(held) for s, d in found]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(d, id_type), pa.array(s, pa.int64())], names=["_x_q", "_x_id", "_x_score"])

    schema = T.StructType([T.StructField("_x_q", T.LongType()), docs.schema["_x_id"], T.StructField("_x_score", T.LongType())])
    return docs.where(F.col("_x_id").isNotNull()).mapInArrow(best, schema)


def best_rows(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` best rows of each item; in two steps, so that no task gets all rows of an item."""
    order = [F.col("_x_score").desc(), F.col("_x_id").asc()]
    for keys in (["_x_q", F.pmod(F.xxhash64("_x_id"), F.lit(SALTS))], ["_x_q"]):
        found = found.withColumn("_x_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_x_rank") <= top)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_id: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item id, ``rank``, document id, ``score``): each item's ``top`` best documents with a score above 0.

    Equal scores rank by rising document id.  Defined results: null and empty texts have no term, are not counted and are not found; an item
    without a term finds nothing; document rows with a null id are counted but not ranked; repeated document rows
    are documents of their own with neighbouring ranks; item rows that repeat id and text are one, rows that share only an id (null included) are items of their own under that id;
    empty tables give no rows; other columns are not looked at.
    """
    terms = materialise(item_terms(items, item_id, item_text), "item-terms")
    table = materialise(document_terms(docs, id_col, text_col, term_map(terms)), "document-terms")
    size = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_x_n"), F.lit(0)).alias("l")).first()
    df = table.select(F.explode("_x_terms").alias("_x_t")).groupBy("_x_t").agg(F.count(F.lit(1)).alias("_x_df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(2 * size.n + 2) / (2 * F.col("_x_df") + 1))).cast("long")
    weighted = materialise(terms.join(df, terms["_x_term"] == df["_x_t"]).select("_x_q", "_x_term", weight.alias("_x_w")), "weighted-terms")
    n = weighted.agg(F.count_distinct("_x_q").alias("q"), F.count(F.lit(1)).alias("t")).first()
    blocks = max(1, -(-n.q // ITEM_BLOCK), -(-n.t // TERM_BLOCK))
    found = []
    for b in range(blocks):
        rows = weighted.where(F.pmod("_x_q", F.lit(blocks)) == b).toPandas() if n.t else None
        if rows is None or not len(rows):
            continue
        keys, item_of = np.unique(rows["_x_q"].to_numpy(), return_inverse=True)
        g = share(item_of, rows["_x_term"].to_numpy(), rows["_x_w"].to_numpy(), len(keys))
        found.append(materialise(search_block(table, g, keys, size.n, size.l, top), "found"))
    names = terms.select("_x_q", "_x_item").distinct()
    if not found:
        found = [table.select(F.lit(0).cast("long").alias("_x_q"), "_x_id", F.lit(0).cast("long").alias("_x_score")).where("false")]
    all_found = found[0]
    for f in found[1:]:
        all_found = all_found.unionByName(f)
    best = best_rows(all_found, top)
    return best.join(names, "_x_q").select(F.col("_x_item").alias(item_id), F.col("_x_rank").cast("int").alias("rank"),
                                           F.col("_x_id").alias(id_col), F.col("_x_score").alias("score"))
