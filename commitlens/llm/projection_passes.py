"""Operator 11 - near-duplicate vectors by sorted projection passes.

Equal vectors of a group (label and dimension) are one class.  In each pass a class gets a code, the signs of its products
with ``BITS`` random directions of that pass; classes are dealt by range and sorted by (group, code), and each is compared
with the next ``WINDOW`` ones, also across the edges of the partitions.  Pairs whose cosine in double precision reaches the
limit are united: a task sends one (class, first class of its chain) row per class, not the pairs, and the links of all passes
go through one connected-components job.  The number of passes follows from the largest group, so that two
vectors at the limit meet in some pass with a probability of ``MEET``, at every size.

The windows bound what a pass compares, not the result: links are counted again, whole, inside the components.

* A component's centre is the mean of a few members.  Members within half the limit's angle of the centre all link to
  each other (angles add up at most), so in a dense group links are counted without comparing anything.
* The other members are compared with all members of their component, in blocks of ``BLOCK`` classes; a block pair sends one
  count per class.

So a group of copies may hold any share of the rows.  A large component that no centre covers (a long chain) costs the square of its
uncovered part, dealt over block pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commitlens.llm.common import digest, materialise, skew_join
from commitlens.llm.components import connected_components

LIMIT = 0.93
BITS = 64           # signs in a code
WINDOW = 64         # next neighbours that a class is compared with
MEET = 0.95         # probability that two vectors at the limit meet in some pass
MIN_PASSES = 4
CENTRE_OF = 32      # members, one per hash value, whose mean is a component's centre
BLOCK = 1024
STRIP = 256         # rows of a window comparison done by one matrix product


def comparable(vector: Column) -> Column:
    """Not null, without null or non-finite parts, not zero."""
    part = vector.cast("array<double>")
    bad = F.exists(part, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(part, lambda x: x != 0), F.lit(False))


def node_of(group: Column, vector: Column) -> Column:
    """128-bit key of a vector within its group (as a string of the label and the dimension)."""
    return digest(F.concat_ws(":", F.xxhash64(vector).cast("string"), F.xxhash64(F.lit(LIMIT), vector).cast("string"), group))


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as rows of unit length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)           # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_dimension(column: pa.Array) -> Iterator[np.ndarray]:
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        yield np.flatnonzero(size == d)


def directions(number: int, dimension: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([number, dimension])).standard_normal((dimension, BITS))


def passes_for(n: int, limit: float) -> int:
    """Passes after which two vectors at the limit have met with probability ``MEET`` in a group of ``n``.

    They meet if their codes agree until about ``WINDOW`` classes are left: log2(n / WINDOW) bits.
    """
    agree = 1 - math.acos(limit) / math.pi
    met = agree ** max(0.0, math.log2(max(1, n) / WINDOW))
    return max(MIN_PASSES, math.ceil(math.log(1 - MEET) / math.log(1 - met)) if met < 1 else 0)


def with_code(classes: DataFrame, number: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((batch.num_rows, BITS // 8), np.uint8)
            for at in by_dimension(batch.column("_x_vec")):
                x = unit_rows(batch.column("_x_vec").take(pa.array(at)))
                code[at] = np.packbits(x @ directions(number, x.shape[1]) > 0, axis=1)
            yield batch.append_column("_x_code", pa.array([c.tobytes() for c in code], pa.binary()))

    return classes.mapInArrow(add, T.StructType(list(classes.schema.fields)).add("_x_code", "binary"))


def chains(x: np.ndarray, limit: float, window: int, across: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, first row of its chain) for rows that link, directly or not, to an earlier row within the window.

    With ``across`` only pairs on both sides of that row count.
    """
    pairs = []
    for a in range(0, len(x), STRIP):
        left, right = x[a:a + STRIP], x[a:a + STRIP + window]
        i, j = np.nonzero(left @ right.T >= limit)
        pairs.append(np.stack([i, j])[:, (j > i) & (j - i <= window)] + a)
    i, j = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    if across is not None:
        i, j = i[(i < across) & (j >= across)], j[(i < across) & (j >= across)]
    first = np.arange(len(x))
    while True:
        new = first.copy()
        np.minimum.at(new, j, first[i])
        np.minimum.at(new, i, first[j])
        new = new[new]
        if (new == first).all():
            break
        first = new
    at = np.flatnonzero(first != np.arange(len(x)))
    return at, first[at]


def runs(group: pa.Array) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    code = pc.run_end_encode(group).run_ends.to_numpy()
    return list(zip([0, *code[:-1].tolist()], code.tolist()))


LINKS = T.StructType().add("a", "binary").add("b", "binary")


def chain_rows(table: pa.Table, limit: float, window: int, across: int | None = None) -> pa.RecordBatch:
    node = table["_x_node"].combine_chunks()
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for begin, end in runs(table["_x_group"].combine_chunks()):
        inner = None if across is None else across - begin
        if end - begin > 1 and (inner is None or 0 < inner < end - begin):
            at, first = chains(unit_rows(table["_x_vec"].slice(begin, end - begin)), limit, window, inner)
            a.append(at + begin)
            b.append(first + begin)
    return pa.RecordBatch.from_arrays([node.take(pa.array(np.concatenate(v))) for v in (a, b)], names=["a", "b"])


def sorted_pass(classes: DataFrame, number: int, limit: float, window: int) -> DataFrame:
    """(a, b) links of one pass: window comparisons inside the sorted partitions, then across their edges."""
    order = ["_x_group", "_x_code", "_x_node"]
    place = F.monotonically_increasing_id()
    dealt = (with_code(classes, number).repartitionByRange(*order).sortWithinPartitions(*order)
             .select("_x_node", "_x_group", "_x_vec", F.shiftright(place, 33).alias("_x_part")))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in dealt.schema.fields], T.StructField("_x_at", T.LongType()), *LINKS.fields])
    names = schema.fieldNames()

    def rows(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.string(), None, pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        vec = columns.get("_x_vec")
        kinds[2] = vec.type if vec is not None else vec_type[0]
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    vec_type: list[pa.DataType] = [pa.null()]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0
        for batch in batches:
            vec_type[0] = batch.schema.field("_x_vec").type
            new = pa.Table.from_batches([batch])
            if seen < window:                    # the partition's first rows meet the last ones of the partition before
                head = new.slice(0, window - seen).combine_chunks()
                yield rows({c: head[c].combine_chunks() for c in head.column_names} | {"_x_at": pa.array(np.arange(seen, seen + len(head)))}, len(head))
            table = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            found = chain_rows(table, limit, window)
            yield rows({"a": found["a"], "b": found["b"]}, found.num_rows)
            seen += len(new)
            held = table.slice(max(0, len(table) - window))
        if held is not None:                     # negative places: the partition's last rows
            held = held.combine_chunks()
            yield rows({c: held[c].combine_chunks() for c in held.column_names} | {"_x_at": pa.array(np.arange(-len(held), 0))}, len(held))

    out = materialise(dealt.mapInArrow(compare, schema), "pass")
    edges = out.where("_x_at is not null")
    parts = edges.select("_x_part").distinct().withColumn("_x_next", F.lead("_x_part").over(Window.orderBy("_x_part")))   # one row per partition
    tails = edges.where("_x_at < 0").join(parts, "_x_part").where("_x_next is not null").withColumn("_x_part", F.col("_x_next")).drop("_x_next")
    edge = tails.unionByName(edges.where("_x_at >= 0"))

    def meet(table: pa.Table) -> pa.Table:       # at most 2 * window rows
        table = table.sort_by("_x_at")
        return pa.Table.from_batches([chain_rows(table, limit, window, int(pc.sum(pc.less(table["_x_at"], 0)).as_py() or 0))])

    return out.where("a is not null").select("a", "b").unionByName(edge.drop("a", "b").groupBy("_x_part").applyInArrow(meet, LINKS))


def covered(members: DataFrame, limit: float) -> DataFrame:
    """``_x_in``: is the class within half the limit's angle of its component's centre."""
    spot = F.pmod(F.xxhash64("_x_node"), F.lit(CENTRE_OF)).alias("_x_i")
    few = members.groupBy("_x_root", spot).agg(F.min(F.struct("_x_node", "_x_vec")).alias("_x_one"))    # combined in the map tasks
    centres = few.groupBy("_x_root").agg(F.collect_list("_x_one._x_vec").alias("_x_few"))
    half = math.cos(math.acos(limit) / 2) + 1e-9

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = batch.column("_x_few")
            size = pc.list_value_length(few).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            inside = np.zeros(batch.num_rows, bool)
            vectors = few.flatten()
            for at in by_dimension(batch.column("_x_vec")):
                flat = np.concatenate([np.arange(e - s, e) for s, e in zip(size[at], ends[at])])
                sums = np.add.reduceat(unit_rows(vectors.take(pa.array(flat))), np.cumsum(size[at]) - size[at])
                norm = np.sqrt((sums * sums).sum(axis=1))
                inside[at] = (unit_rows(batch.column("_x_vec").take(pa.array(at))) * sums).sum(axis=1) >= half * norm
            out = pa.Table.from_batches([batch]).drop_columns(["_x_few"]).append_column("_x_in", pa.array(inside))
            yield from out.to_batches()

    joined = skew_join(members, centres, ["_x_root"])
    return joined.mapInArrow(judge, T.StructType([f for f in joined.schema.fields if f.name != "_x_few"]).add("_x_in", "boolean"))


def cross_counts(members: DataFrame, sizes: DataFrame, limit: float) -> DataFrame:
    """(_x_node, _x_add): links of classes outside their component's centre, and links of covered classes to those."""
    open_roots = sizes.where("_x_rest > 0").select("_x_root", F.ceil(F.col("_x_rest") / BLOCK).cast("int").alias("_x_ni"),
                                                   F.ceil(F.col("_x_all") / BLOCK).cast("int").alias("_x_nj"))
    rows = skew_join(members, open_roots, ["_x_root"])
    spot = F.xxhash64("_x_node")
    left = (rows.where(~F.col("_x_in")).withColumn("_x_i", F.pmod(spot, F.col("_x_ni")).cast("int"))
            .withColumn("_x_j", F.explode(F.sequence(F.lit(0), F.col("_x_nj") - 1))).withColumn("_x_side", F.lit(0)))
    right = (rows.withColumn("_x_j", F.pmod(spot, F.col("_x_nj")).cast("int"))
             .withColumn("_x_i", F.explode(F.sequence(F.lit(0), F.col("_x_ni") - 1))).withColumn("_x_side", F.lit(1)))
    keys = ["_x_root", "_x_i", "_x_j"]
    columns = [*keys, "_x_side", "_x_node", "_x_n", "_x_in", "_x_vec"]
    both = left.select(*columns).unionByName(right.select(*columns)).repartition(*keys).sortWithinPartitions(*keys, "_x_side")
    both = both.withColumn("_x_group", F.concat_ws(":", F.hex("_x_root"), "_x_i", "_x_j")).drop(*keys)

    def block(t: pa.Table) -> pa.Table:
        side = t["_x_side"].to_numpy() == 1
        node = t["_x_node"].combine_chunks()
        x, n, inside = unit_rows(t["_x_vec"]), t["_x_n"].to_numpy(), t["_x_in"].to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        ids = node.dictionary_encode().indices.to_numpy()
        linked = (x[a] @ x[b].T >= limit) & (ids[a][:, None] != ids[b][None, :])
        add = np.concatenate([linked @ n[b], np.where(inside[b], n[a] @ linked, 0)])
        out = pa.table({"_x_node": node.take(pa.array(np.concatenate([a, b]))), "_x_add": pa.array(add, pa.int64())})
        return out.filter(pa.array(add > 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                              # the last group of the batches so far: at most about 2 * BLOCK rows
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = (pa.concat_tables([held, new]) if held is not None else new).combine_chunks()
            spans = runs(held["_x_group"].combine_chunks())
            for begin, end in spans[:-1]:
                yield from block(held.slice(begin, end - begin)).to_batches()
            held = held.slice(spans[-1][0]).combine_chunks()
        if held is not None:
            yield from block(held).to_batches()

    return both.mapInArrow(count, "_x_node binary, _x_add long").groupBy("_x_node").agg(F.sum("_x_add").alias("_x_add"))


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 limit: float = LIMIT, window: int = WINDOW, passes: int | None = None) -> DataFrame:
    """The input rows with ``n_links``, ``component_id`` and ``kept``.

    Vectors are compared only if their labels are equal and not null and their dimensions agree.  ``n_links`` counts the other
    vectors of the component with a cosine of at least ``limit``, ``component_id`` is the smallest id reachable by links,
    ``kept`` tells whether it is the row's own.  Defined results: vectors that are null, empty, zero, or hold null or non-finite
    parts, and rows with a null id, link with nothing (0 links, their own id, kept; a null id has a null component and is
    kept); rows that repeat id, label and vector are one vector and share its result; rows that share only the id are
    vectors of their own; input columns called ``n_links``, ``component_id`` or ``kept`` are replaced, other columns are carried along.
    """
    vec, label = F.col(f"`{vector_col}`"), F.col(f"`{label_col}`")
    group = F.concat_ws("/", F.size(vec).cast("string"), label.cast("string"))
    fit = comparable(vec) & label.isNotNull() & F.col(f"`{id_col}`").isNotNull()
    rows = vectors.withColumn("_x_node", F.when(fit, node_of(group, vec)))
    valid = rows.where("_x_node is not null").select("_x_node", F.col(f"`{id_col}`").alias("_x_id"), group.alias("_x_group"), vec.alias("_x_vec"))
    copies = (valid.select("_x_node", "_x_id").distinct().groupBy("_x_node")
              .agg(F.count(F.lit(1)).alias("_x_n"), F.min("_x_id").alias("_x_least")))
    one = valid.groupBy("_x_node").agg(F.first("_x_group").alias("_x_group"), F.first("_x_vec").alias("_x_vec"))
    classes = materialise(one.join(copies, "_x_node"), "vector-classes")
    largest = classes.groupBy("_x_group").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    links = None
    for p in range(passes or passes_for(largest, limit)):
        found = materialise(sorted_pass(classes.select("_x_node", "_x_group", "_x_vec"), p, limit, window), "pass-links")
        links = found if links is None else links.unionByName(found)
    roots = connected_components(links).withColumnsRenamed({"node": "_x_node", "root": "_x_root"})
    members = materialise(covered(classes.drop("_x_group", "_x_least").join(roots, "_x_node"), limit), "members")
    weight = F.when(F.col("_x_in"), F.col("_x_n")).otherwise(0)
    sizes = materialise(members.groupBy("_x_root").agg(F.sum(weight).alias("_x_dense"), F.count(F.lit(1)).alias("_x_all"),
                                                       F.count_if(~F.col("_x_in")).alias("_x_rest")), "component-sizes")
    least = members.select("_x_node", "_x_root").join(classes.select("_x_node", "_x_least"), "_x_node").groupBy("_x_root").agg(F.min("_x_least").alias("_x_component"))
    whole = sizes.join(least, "_x_root").select("_x_root", "_x_dense", "_x_component")
    own = skew_join(members.drop("_x_vec"), whole, ["_x_root"])
    linked = own.join(cross_counts(members, sizes, limit), "_x_node", "left").select(
        "_x_node", "_x_component", (F.when(F.col("_x_in"), F.col("_x_dense")).otherwise(F.col("_x_n")) - 1 + F.coalesce("_x_add", F.lit(0))).alias("_x_links"))
    result = materialise(copies.join(linked, "_x_node", "left").where((F.col("_x_n") > 1) | F.col("_x_links").isNotNull()).select(
        "_x_node", F.coalesce("_x_links", F.col("_x_n") - 1).alias("_x_links"), F.coalesce("_x_component", "_x_least").alias("_x_component")), "vector-links")
    keep = [c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept") or c == id_col]
    out = skew_join(rows, result, ["_x_node"], "left")
    component = F.coalesce(F.col("_x_component"), F.col(f"`{id_col}`"))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("_x_links"), F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col(f"`{id_col}`"), F.lit(True)).alias("kept"))
