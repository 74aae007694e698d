"""Approximate nearest neighbours by a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt to shards of bounded size by a hash. A shard's graph is built in one task and written as one row of flat
arrays: the vectors, and for each level the nodes it holds and their neighbours, -1 where there are fewer. Vectors are inserted in groups that search
the graph of those before them in step: a round takes the best unvisited nodes of every search, and scores all their neighbours at once. Neighbours are
chosen so that no chosen one is closer to another than to the vector itself, which keeps paths between clusters.

Queries come in blocks, meet every shard of their length, and search in the same way; the best of all shards are merged. Graphs are walked in
single precision, scores are exact cosines in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from limnos.functions.nulls import col
from limnos.session import staged

#: Distinct vectors of a shard and queries of a block, on average.
SHARD_ROWS = 8_192
BLOCK_ROWS = 1_024
#: Neighbours of a node on the upper levels; the ground level keeps twice as many.
LINKS = 16
#: Nodes a search holds while the graph is built, and while it is queried.
BUILD_WIDTH = 64
SEARCH_WIDTH = 192
#: Nodes of each search a round takes.
STEP = 4
#: Vectors inserted together, at most; and at most a share of those present.
INSERT_ROWS = 512
#: Ids kept of equal vectors beyond the number of neighbours asked for: the query's own.
SPARE = 1
NEAREST_MOST = 100


class Graph(NamedTuple):
    """``nodes[l]`` are the vectors of level l in order, ``links[l]`` their neighbours (numbers of vectors, -1 behind the last)."""
    vectors: np.ndarray
    nodes: list[np.ndarray]
    links: list[np.ndarray]


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; a power of two is taken out first, so that no square over- or underflows."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    scaled = np.ldexp(vectors, -exponent[:, None])
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, summed in the order of the components, so equal vectors have equal scores."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    _, ea = np.frexp(np.abs(a).max(axis=1, initial=0.0))
    _, eb = np.frexp(np.abs(b).max(axis=1, initial=0.0))
    for k in range(a.shape[1]):
        x, y = np.ldexp(a[:, k], -ea), np.ldexp(b[:, k], -eb)
        dot += x * y
        aa += x * x
        bb += y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def levels_of(count: int, seed: int = 0) -> np.ndarray:
    """Top level of each vector: one in ``LINKS`` reaches the next level."""
    draws = np.random.default_rng(seed).random(count)
    return np.floor(-np.log(1.0 - draws) / np.log(LINKS)).astype(np.int64)


def walk(queries: np.ndarray, vectors: np.ndarray, place: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query, best first, and their products; -1 where there are fewer.

    ``place`` gives the row of ``links`` of a vector, ``entry`` the nodes each search starts from.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(vectors) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    held = np.full((n, width), -1, np.int64)
    score = np.full((n, width), -np.inf, np.float32)
    done = np.ones((n, width), bool)
    entry = entry[:, :width]
    first = np.einsum("nd,nkd->nk", queries, vectors[entry])
    repeated = np.zeros(entry.shape, bool)
    for k in range(1, entry.shape[1]):
        repeated[:, k] = (entry[:, :k] == entry[:, k:k + 1]).any(axis=1)
    held[:, :entry.shape[1]], score[:, :entry.shape[1]], done[:, :entry.shape[1]] = np.where(repeated, -1, entry), np.where(repeated, -np.inf, first), repeated
    seen[rows, entry] = True
    active = np.arange(n)
    while len(active):
        at = np.arange(len(active))[:, None]
        h, s, d = held[active], score[active], done[active]
        pick = np.argsort(np.where(d, np.inf, -s), axis=1, kind="stable")[:, :STEP]
        open_ = ~d[at, pick]
        d[at, pick] = True
        expand = np.where(open_, h[at, pick], -1)
        new = np.where(expand[:, :, None] >= 0, links[place[expand]], -1).reshape(len(active), -1)
        fresh = ~seen[active[:, None], new]
        new = np.where(fresh, new, -1)
        ordered = np.sort(new, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        seen[active[:, None], ordered] = True
        found = np.full(ordered.shape, -np.inf, np.float32)
        who, where = np.nonzero(ordered >= 0)
        found[who, where] = np.einsum("kd,kd->k", queries[active[who]], vectors[ordered[who, where]])
        h, s, d = np.concatenate((h, ordered), axis=1), np.concatenate((s, found), axis=1), np.concatenate((d, ordered < 0), axis=1)
        best = np.argsort(-s, axis=1, kind="stable")[:, :width]
        held[active], score[active], done[active] = h[at, best], s[at, best], d[at, best]
        active = active[~done[active].all(axis=1)]
    order = np.argsort(-score, axis=1, kind="stable")
    return held[rows, order], score[rows, order]


def choose(vectors: np.ndarray, owners: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """For each owner, up to ``most`` of its candidates (-1 for none), nearest first, none of them nearer to one chosen before than to the owner.

    Places left over go to the nearest candidates that were passed by.
    """
    out = np.full((len(owners), most), -1, np.int64)
    for start in range(0, len(owners), 256):
        own, cand = vectors[owners[start:start + 256]], candidates[start:start + 256]
        rows = np.arange(len(own))
        points = vectors[cand]
        near = np.where(cand >= 0, np.einsum("nd,ncd->nc", own, points), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near, points = cand[rows[:, None], order], near[rows[:, None], order], points[rows[:, None], order]
        between = np.matmul(points, points.transpose(0, 2, 1))
        kept = np.zeros(cand.shape, bool)
        for c in range(cand.shape[1]):
            closest = np.where(kept, between[:, c], -np.inf).max(axis=1)
            kept[:, c] = (cand[:, c] >= 0) & (near[:, c] > closest) & (kept.sum(axis=1) < most)
        rank = np.argsort(np.where(kept, 0, np.where(cand >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out[start:start + 256, :rank.shape[1]] = cand[rows[:, None], rank]
    return out


def build_graph(vectors: np.ndarray, seed: int = 0) -> Graph:
    """Graph of unit vectors, inserted in their order."""
    count = len(vectors)
    top = levels_of(count, seed)
    height = int(top.max(initial=0))
    nodes = [np.nonzero(top >= l)[0] for l in range(height + 1)]
    place = [np.full(count + 1, -1, np.int64) for _ in nodes]
    for p, held in zip(place, nodes):
        p[held] = np.arange(len(held))
    links = [np.full((len(held) + 1, 2 * LINKS if l == 0 else LINKS), -1, np.int64) for l, held in enumerate(nodes)]
    start = 0
    while start < count:
        # The first vectors are linked among themselves, later ones to the graph before them and to each other.
        end = min(count, start + min(INSERT_ROWS, max(2 * LINKS, start)))
        batch = np.arange(start, end)
        entry = np.full((len(batch), 1), int(top[:start].argmax()) if start else -1, np.int64)
        for level in range(height, -1, -1):
            present = nodes[level][nodes[level] < start]
            members = batch[top[batch] >= level]
            found = np.zeros((len(batch), 0), np.int64)
            if len(present):
                found, _ = walk(vectors[batch], vectors, place[level], links[level], entry, BUILD_WIDTH if len(members) else 1)
                entry = found[:, :1]
            if not len(members):
                continue
            peers = np.matmul(vectors[members], vectors[members].T)
            np.fill_diagonal(peers, -np.inf)
            close = np.argsort(-peers, axis=1, kind="stable")[:, :min(len(members) - 1, LINKS)]
            options = np.concatenate((found[members - start], members[close]), axis=1)
            if not options.shape[1]:
                continue
            mine = choose(vectors, members, options, LINKS)
            links[level][place[level][members], :LINKS] = mine
            _link_back(vectors, place[level], links[level], members, mine)
        start = end
    return Graph(vectors, nodes, [l[:-1] for l in links])


def _link_back(vectors: np.ndarray, place: np.ndarray, links: np.ndarray, members: np.ndarray, mine: np.ndarray) -> None:
    """Add the new nodes to the neighbours of those they chose; where there is no room, choose again."""
    target, source = mine.ravel(), np.repeat(members, mine.shape[1])
    known = target >= 0
    target, source = target[known], source[known]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    owners, first, sizes = np.unique(target, return_index=True, return_counts=True)
    offset = np.arange(len(target)) - np.repeat(first, sizes)
    added = np.full((len(owners), int(sizes.max(initial=0))), -1, np.int64)
    added[np.repeat(np.arange(len(owners)), sizes), offset] = source
    old = links[place[owners]]
    added = np.where((added[:, :, None] == old[:, None, :]).any(axis=2), -1, added)
    every = np.concatenate((old, added), axis=1)
    room = links.shape[1]
    fits = (every >= 0).sum(axis=1) <= room
    packed = np.argsort(every < 0, axis=1, kind="stable")[:, :room]
    links[place[owners[fits]]] = np.take_along_axis(every, packed, axis=1)[fits]
    if (~fits).any():
        links[place[owners[~fits]]] = choose(vectors, owners[~fits], every[~fits], room)


def search_graph(graph: Graph, queries: np.ndarray, width: int = SEARCH_WIDTH) -> np.ndarray:
    """Numbers of the vectors found for each unit query, best first, -1 where there are fewer."""
    count = len(graph.vectors)
    entry = np.full((len(queries), 1), int(graph.nodes[-1][0]), np.int64)
    found = entry
    for level in range(len(graph.nodes) - 1, -1, -1):
        place = np.full(count + 1, -1, np.int64)
        place[graph.nodes[level]] = np.arange(len(graph.nodes[level]))
        links = np.concatenate((graph.links[level], np.full((1, graph.links[level].shape[1]), -1, np.int64)))
        found, _ = walk(queries, graph.vectors, place, links, entry, width if level == 0 else 1)
        entry = found[:, :1]
    return found


# Tables

def _classes(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, vector, size, name`` of the rows that take part; ``name`` stands for the components."""
    x = F.col("vector")
    good = (x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0))
    numbers = F.transform(x, lambda v: v + F.lit(0.0))  # no negative zero
    hashes = [F.lpad(F.hex(F.xxhash64(F.lit(seed), numbers)), 16, "0") for seed in (1, 2)]
    return (rows.select(col(vec_id).alias("vec_id"), col(vector).cast("array<double>").alias("vector")).where(good)
            .withColumn("size", F.size("vector")).withColumn("name", F.concat(*hashes)))


def _bucket(name: Column, rows: Column, each: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), name), F.ceil(rows / each)).cast("int")


def _matrix(values: pa.Array, count: int) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).reshape(count, -1)


def _build_shard(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("name")
    vectors = _matrix(rows["vector"].combine_chunks().flatten(), len(rows))
    graph = build_graph(directions(vectors))
    nodes, links = np.concatenate(graph.nodes), np.concatenate([x.ravel() for x in graph.links])
    return pa.table({"size": rows["size"].slice(0, 1), "shard": rows["shard"].slice(0, 1), "ids": pa.array([rows["ids"].to_pylist()], pa.list_(rows.schema.field("ids").type)),
                     "vectors": pa.array([vectors.ravel()], pa.list_(pa.float64())), "counts": pa.array([[len(x) for x in graph.nodes]], pa.list_(pa.int32())),
                     "nodes": pa.array([nodes.astype(np.int32)], pa.list_(pa.int32())), "links": pa.array([links.astype(np.int32)], pa.list_(pa.int32()))})


def build(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST_MOST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: one row for each shard, ``size, shard, ids, vectors, counts, nodes, links``, for up to ``nearest`` neighbours.

    Columns beyond id and vector are not read, whatever their names. Vectors that are null, empty, zero or hold a null or non-finite component take no part. Equal vectors are one node, with the ``nearest`` + 1 smallest ids
    (null last): no more of them can be among the nearest. Vectors of different lengths are in different shards.
    """
    rows = _classes(table, vec_id, vector)
    by_id = Window.partitionBy("size", "name").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= nearest + SPARE)  # limited before the shuffle
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"])
    classes = staged(few.groupBy("size", "name").agg(F.first("vector").alias("vector"), ids.alias("ids")))
    sizes = staged(classes.groupBy(F.col("size").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    dealt = classes.join(sizes, F.col("size") == F.col("s")).withColumn("shard", _bucket(F.col("name"), F.col("n"), shard_rows)).drop("s", "n")
    kind = rows.schema["vec_id"].dataType.simpleString()
    return staged(dealt.groupBy("size", "shard").applyInArrow(
        _build_shard, f"size int, shard int, ids array<array<{kind}>>, vectors array<double>, counts array<int>, nodes array<int>, links array<int>"))


def _search_blocks(take: int, width: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].values for n in batch.schema.names if n not in ("size", "shard")}
                ids, size = row["ids"].to_pylist(), batch.column("size")[i].as_py()
                vectors, asked = _matrix(row["vectors"], len(ids)), _matrix(row["asked"].flatten(), len(row["asked"]))
                counts, nodes, links = (row[n].to_numpy().astype(np.int64) for n in ("counts", "nodes", "links"))
                ends, per = np.cumsum(counts), np.where(np.arange(len(counts)) == 0, 2 * LINKS, LINKS)
                link_ends = np.cumsum(counts * per)
                graph = Graph(directions(vectors), [nodes[e - c:e] for e, c in zip(ends, counts)],
                              [links[e - c * p:e].reshape(c, p) for e, c, p in zip(link_ends, counts, per)])
                names = row["names"].to_pylist()
                found = search_graph(graph, directions(asked), max(width, take))
                q, at = np.nonzero(found >= 0)
                score = exact_cosines(asked[q], vectors[found[q, at]])
                out: list[tuple] = []
                for k in range(len(names)):
                    mine = np.nonzero(q == k)[0]
                    best = sorted(((-score[m], v is None, v) for m in mine for v in ids[found[k, at[m]]]), key=lambda t: t[:2] + ((t[2],) if t[2] is not None else ()))[:take]
                    out += [(names[k], v, -s) for s, _, v in best]
                columns = list(zip(*out)) if out else [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(out), pa.int32()), pa.array(columns[0], pa.string()), pa.array(columns[1], id_type), pa.array(columns[2], pa.float64())],
                                                 names=["size", "name", "vec_id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding", width: int = SEARCH_WIDTH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query, other than its own id.

    Nearest is the largest cosine; ties go to the smaller id, null last. Fewer candidates give fewer rows. Queries that take no part (see ``build``) have none. Equal
    queries are searched once; a repeated id is a query of its own for each of its vectors and never its own neighbour. Empty tables give an empty result;
    other columns are not read.
    """
    rows = staged(_classes(queries, vec_id, vector))
    asked = staged(rows.groupBy("size", "name").agg(F.first("vector").alias("vector")))
    sizes = staged(asked.groupBy(F.col("size").alias("s")).agg(F.count(F.lit(1)).alias("n")))
    blocks = (asked.join(sizes, F.col("size") == F.col("s")).withColumn("block", _bucket(F.col("name"), F.col("n"), BLOCK_ROWS))
              .groupBy("size", "block").agg(F.collect_list("name").alias("names"), F.collect_list("vector").alias("asked")))
    shards = staged(index.groupBy(F.col("size").alias("s")).agg(F.max("shard").alias("last")))  # one row per length
    sent = blocks.join(shards, F.col("size") == F.col("s")).select("size", "names", "asked", F.explode(F.sequence(F.lit(0), "last")).alias("shard"))
    pairs = staged(sent).join(index, ["size", "shard"])
    kind = rows.schema["vec_id"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    best = pairs.mapInArrow(_search_blocks(k + SPARE, width, id_type), f"size int, name string, vec_id {kind}, score double")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last()]
    merged = staged(best.withColumn("r", F.row_number().over(Window.partitionBy("size", "name").orderBy(*order))).where(F.col("r") <= k + SPARE).drop("r"))
    names = rows.select(F.col("vec_id").alias("query_id"), F.col("name").alias("n"), F.col("size").alias("s")).distinct()
    others = names.join(merged, (F.col("n") == F.col("name")) & (F.col("s") == F.col("size"))).where(~F.col("query_id").eqNullSafe(F.col("vec_id")))
    return (others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "n", "s").orderBy(*order))).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
