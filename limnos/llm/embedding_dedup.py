"""Near-duplicate vectors by an exact metric range join.

Unit vectors of a label are dealt to the cells of their nearest pivots. Cosine at least c means a distance of at most
r = sqrt(2 - 2c), so by the triangle inequality a vector x of cell i can have a partner y in cell j only if
d(x, p_j) <= d(x, p_i) + 2r (p_i is the nearest pivot of x), and d(x, p_j) <= R_j + r, where R_j is the largest distance in
cell j. Such vectors are copied to cell j, each pair of cells in one direction only. The cells are then joined by
themselves, in blocks of bounded size; a block returns counts per vector and a forest of links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from limnos.functions.nulls import col
from limnos.llm.shared import components
from limnos.session import staged

COSINE = 0.93
#: Vectors a pivot stands for, and the most pivots of a label; fuller cells are joined in more blocks.
CELL_ROWS = 4_096
MAX_PIVOTS = 256
#: Vectors on a side of a block.
BLOCK_ROWS = 1_024
#: Slack for rounding in distances that only prune.
SLACK = 1e-6


def unit(flat: np.ndarray) -> np.ndarray:
    """Rows of length one; a power of two is taken out first, so that no square over- or underflows."""
    flat = flat.astype(np.float64)
    flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(axis=1, keepdims=True, initial=0.0))[1])
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of links between numbered vectors."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            kept.append((x, y))
    return kept


def _join_block(cosine: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """Links between the two sides of a block; on the diagonal both sides are the same vectors."""
        side, copies = rows["side"].to_numpy(), rows["copies"].to_numpy()
        ids = rows["id"].to_pylist()
        x = unit(matrix(rows["vector"]))
        left = np.nonzero(side == 0)[0]
        right = np.nonzero(side == 1)[0] if key[-1].as_py() else left
        links = np.zeros(len(ids), np.int64)
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            near = x[left] @ x[right].T >= cosine
            if not key[-1].as_py():
                np.fill_diagonal(near, False)
                links[left] = near @ copies[left]
                a, b = np.nonzero(np.triu(near))
            else:
                links[left] = near @ copies[right]
                links[right] = copies[left] @ near
                a, b = np.nonzero(near)
            edges = forest(left[a], right[b])
        own = np.nonzero(links)[0]
        return pa.table({"id": pa.array([ids[i] for i in own] + [ids[a] for a, _ in edges], pa.string()),
                         "links": pa.array([int(links[i]) for i in own] + [None] * len(edges), pa.int64()),
                         "other": pa.array([None] * len(own) + [ids[b] for _, b in edges], pa.string())})
    return run


def _cells(pivots: dict[tuple, np.ndarray]):
    """Cell of each vector and its distances to all pivots of its label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            cell = np.zeros(batch.num_rows, np.int32)
            far: list[list[float]] = [[] for _ in keys]
            by_label: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                by_label.setdefault(k, []).append(i)
            for k, at in by_label.items():
                x = unit(matrix(batch.column(3).take(pa.array(at))))
                d = np.sqrt(np.maximum(2.0 - 2.0 * (x @ pivots[k].T), 0.0))
                cell[at] = d.argmin(axis=1)
                for i, row in zip(at, d.tolist()):
                    far[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far, pa.list_(pa.float64()))],
                                             names=["id", "label", "size", "vector", "copies", "cell", "far"])
    return run


def similar_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row for each vector.

    ``n_links`` counts the other rows of the same label and length with a cosine of at least ``cosine`` in double precision,
    ``component_id`` is the smallest id reachable over links, itself included. A vector that is null or zero, holds a null or a
    non-finite number, or has no label links with nothing. Equal vectors are one vector with copies: they are never compared,
    however many there are, and each counts the others. Null ids do not count as smallest; a component of null ids only has a null
    component_id and is not kept. Repeated rows are copies. An empty table gives an empty result; no other column is read.

    Each label takes about one pivot per ``CELL_ROWS`` vectors, at most ``MAX_PIVOTS`` (the bound of what is broadcast). Where
    vectors spread evenly in many dimensions no bound can prune, and the join becomes all blocks against all blocks of a label.
    """
    x = F.col("vector")
    numbers = F.transform(x, lambda v: v.cast("double"))
    good = (F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
            & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0))
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", numbers)), 16, "0") for seed in (1, 2)]
    rows = staged(table.select(col(vec_id).alias("vec_id"), col(label).alias("label"), col(vector).alias("vector"))
                  .withColumn("id", F.when(F.coalesce(good, F.lit(False)), F.concat(*hashes))))
    classes = staged(rows.where("id is not null").groupBy("id").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"))
        .withColumn("size", F.size("vector")))

    spot = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") / float(2 ** 53)
    sizes = classes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(spot.alias("spot"), "id"))["id"].alias("first"))
    wanted = staged(sizes.withColumn("share", F.least(F.ceil(F.col("n") / CELL_ROWS), F.lit(MAX_PIVOTS)) / F.col("n")))
    # More than the share is drawn, so that a label gets its pivots of an even spread of its vectors; the first vector makes sure of one.
    drawn = (classes.join(wanted.withColumnRenamed("size", "s").withColumnRenamed("label", "l"), F.col("label").eqNullSafe(F.col("l")) & (F.col("size") == F.col("s")))
             .where((spot <= F.col("share") + 8 / F.col("n")) | (F.col("id") == F.col("first"))))
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("label", "size").orderBy(spot, "id"))).where(F.col("r") <= F.greatest(F.lit(1), F.round(F.col("share") * F.col("n"))))
    chosen = ranked.select("label", "size", "id", "vector").orderBy("label", "size", "id").collect()
    pivots: dict[tuple, np.ndarray] = {}
    for r in chosen:
        pivots.setdefault((r["label"], r["size"]), []).append(r["vector"])
    pivots = {k: unit(np.array(v)) for k, v in pivots.items()}

    kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
    placed = staged(classes.select("id", "label", "size", "vector", "copies").mapInArrow(
        _cells(pivots), f"id string, label {kinds['label']}, size int, vector {kinds['vector']}, copies long, cell int, far array<double>"))
    reach = math.sqrt(2.0 - 2.0 * cosine) + SLACK
    cells = staged(placed.groupBy("label", "size", "cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.get("far", F.col("cell"))).alias("radius")))
    homes = cells.select(F.col("label").alias("l"), F.col("size").alias("s"), F.struct("cell", "n", "radius").alias("c")).groupBy("l", "s").agg(F.sort_array(F.collect_list("c")).alias("cells"))
    # One row per label, with at most MAX_PIVOTS cells.
    known = placed.join(homes, F.col("label").eqNullSafe(F.col("l")) & (F.col("size") == F.col("s")))
    own = F.get("far", F.col("cell"))
    near = F.filter("cells", lambda c: (c["cell"] == F.col("cell")) | ((c["cell"] > F.col("cell")) & (F.get("far", c["cell"]) <= own + 2 * reach) & (F.get("far", c["cell"]) <= c["radius"] + reach)))
    copied = known.select("id", "label", "size", "vector", "copies", F.col("cell").alias("home"), F.explode(near).alias("c"),
                          F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]["n"].alias("n_home"))
    digest = F.shiftrightunsigned(F.xxhash64(F.lit("block"), "id"), 1)
    blocks = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    # A block of the home cell against itself, a later home block, or a block of the copies that came from another cell.
    mine = copied.withColumn("blocks", blocks(F.col("c.n"))).withColumn("from_blocks", blocks(F.col("n_home")))
    at_home = mine.where("home = c.cell").withColumn("b", (digest % F.col("blocks")).cast("int"))
    foreign = mine.where("home <> c.cell").withColumn("b", (digest % F.col("from_blocks")).cast("int"))
    unit_key = lambda first, second, source: F.struct(F.col("label"), F.col("size"), F.col("c.cell").alias("cell"), first.alias("x"), source.alias("source"), second.alias("y"))
    span = F.sequence(F.lit(0), F.col("blocks") - 1)
    inside = at_home.select("id", "vector", "copies", F.explode(F.transform(span, lambda o: F.struct(
        unit_key(F.least(F.col("b"), o), F.greatest(F.col("b"), o), F.col("c.cell")).alias("unit"), F.when(F.col("b") <= o, 0).otherwise(1).alias("side"), (F.col("b") != o).alias("two"))))
        .alias("u")).select("id", "vector", "copies", "u.*")
    others = foreign.select("id", "vector", "copies", F.explode(F.transform(span, lambda o: unit_key(o, F.col("b"), F.col("home")))).alias("unit"), F.lit(1).alias("side"), F.lit(True).alias("two"))
    came = foreign.select("label", "size", "c.cell", "home", "from_blocks").distinct().withColumnsRenamed({"label": "l2", "size": "s2", "cell": "c2", "home": "h2", "from_blocks": "f2"})
    hosts = (at_home.join(came, F.col("label").eqNullSafe(F.col("l2")) & (F.col("size") == F.col("s2")) & (F.col("c.cell") == F.col("c2")))
             .select("id", "vector", "copies", F.explode(F.transform(F.sequence(F.lit(0), F.col("f2") - 1), lambda o: unit_key(F.col("b"), o, F.col("h2")))).alias("unit"),
                     F.lit(0).alias("side"), F.lit(True).alias("two")))
    joined = staged(inside.unionByName(others).unionByName(hosts).groupBy("unit", "two").applyInArrow(_join_block(cosine), "id string, links long, other string"))

    linked = joined.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    found = components(joined.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    rooted = classes.select("id", "low", "copies").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    facts = staged(rooted.join(lowest, "root").join(linked, "id", "left").select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.select("vec_id", "id").join(facts, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
