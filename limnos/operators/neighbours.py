"""Exact k nearest neighbours over a two-level index of pivots.

The training rows belong to the cell of a pivot; there are as many cells as the square root of the rows, and pivots are grouped
under as many centres as the square root of the cells. A first look into the home cell of every query gives the true distance
of a k-th neighbour. Only cells that a ball of that radius touches can hold a nearer one: those whose nearest and farthest
row, seen from their pivot, the triangle inequality allows, looked up under the centres it allows. Runs of cells make shards of
bounded size, so that a query is copied once for each shard that holds a touched cell, and not once for each cell. Copies of a vector
are collapsed first on both sides, and large cells are spread, so neither a hot vector nor a hot cell lands in one task. A block of queries meets
a shard in one task: products of the vectors leave the rows that can be among the k best, distances rank them, and only the k best leave it.
Nothing is approximated or capped.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from limnos.functions.draws import draw, shuffled_position
from limnos.functions.nulls import col, drop_null_rows
from limnos.functions.ranks import first_k
from limnos.session import shuffle_width, staged

#: Bytes of pivots sent to every task; beyond (about 60,000 pivots of 64 numbers) cells grow instead of their number.
PIVOT_BYTES = 1 << 25
#: Rows of a home cell in the first look; tables of no more are not parted.
TRAIN_BLOCK = 4096
QUERY_BLOCK = 1024
#: Bytes of vectors of a shard of train rows or a block of queries; pairs of them wanted on small tables; distances held at once.
BLOCK_BYTES = 1 << 25
GRID = 48
PAIRS = 1 << 21


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[col(c).cast("double") for c in columns])


class Index(NamedTuple):
    """Centres, and pivots in the order of their centres; ``first`` is where a centre's pivots begin, one more than there are centres.

    For each cell: rows held, rows a query surely may see, and the least and greatest distance from its pivot; for each centre the greatest
    distance of a row from it.
    """
    centres: np.ndarray
    pivots: np.ndarray
    first: np.ndarray
    held: np.ndarray
    sure: np.ndarray
    least: np.ndarray
    greatest: np.ndarray
    spread: np.ndarray


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of n vectors to p pivots, n x p."""
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _grouped(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, pivots ordered by the nearest centre, and where the pivots of each begin."""
    centres = pivots[:math.ceil(math.sqrt(len(pivots)))]
    owner = _gaps(pivots, centres).argmin(axis=1)
    order = np.argsort(owner, kind="stable")
    return centres, pivots[order], np.searchsorted(owner[order], np.arange(len(centres) + 1))


def home_cells(vectors: np.ndarray, centres: np.ndarray, pivots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each vector (the nearest pivot of the nearest centre), the distance to its pivot and to its centre."""
    to_centre = _gaps(vectors, centres)
    owner = to_centre.argmin(axis=1)
    cell, gap = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for c in np.unique(owner):
        at = np.flatnonzero(owner == c)
        gaps = _gaps(vectors[at], pivots[first[c]:first[c + 1]])
        cell[at] = first[c] + gaps.argmin(axis=1)
        gap[at] = gaps.min(axis=1)
    return cell, gap, to_centre[np.arange(len(vectors)), owner]


def touched_cells(vectors: np.ndarray, radius: np.ndarray, k: int, index: Index) -> list[np.ndarray]:
    """Cells that can hold one of the k nearest rows of each vector.

    ``radius`` is the distance of some k-th row, or not a number where none is known: then cells are taken by their farthest
    possible row until they surely hold k rows.
    """
    found: list[list[np.ndarray]] = [[] for _ in vectors]
    blind = np.flatnonzero(np.isnan(radius))
    radius = radius.copy()
    if len(blind):
        farthest = _gaps(vectors[blind], index.pivots) + index.greatest
        order = farthest.argsort(axis=1)
        enough = index.sure[order].cumsum(axis=1) >= k
        rows = np.arange(len(blind))
        radius[blind] = np.where(enough.any(axis=1), farthest[rows, order[rows, enough.argmax(axis=1)]], np.inf)
    radius = radius * (1 + 1e-9) + 1e-9  # slack for rounding in distances that only prune
    to_centre = _gaps(vectors, index.centres)
    for c in range(len(index.centres)):
        at = np.flatnonzero(to_centre[:, c] - index.spread[c] <= radius)
        cells = np.arange(index.first[c], index.first[c + 1])
        cells = cells[index.held[cells] > 0]
        if not len(at) or not len(cells):
            continue
        gaps = _gaps(vectors[at], index.pivots[cells])
        inside = (gaps - index.greatest[cells] <= radius[at, None]) & (index.least[cells] - gaps <= radius[at, None])
        for i, row in zip(at, inside):
            found[i].append(cells[row])
    return [np.concatenate(f).astype("int32") if f else np.zeros(0, "int32") for f in found]


def _home_udf(centres: np.ndarray, pivots: np.ndarray, first: np.ndarray):
    @F.pandas_udf("cell int, gap double, spread double")
    def home(vectors: pd.Series) -> pd.DataFrame:
        cell, gap, spread = home_cells(np.stack(vectors.to_list()), centres, pivots, first)
        return pd.DataFrame({"cell": cell.astype("int32"), "gap": gap, "spread": spread})
    return home


def _touched_udf(index: Index, k: int):
    @F.pandas_udf("array<int>")
    def touched(vectors: pd.Series, radius: pd.Series) -> pd.Series:
        return pd.Series(touched_cells(np.stack(vectors.to_list()), radius.to_numpy(float), k, index))
    return touched


def _rough_best(asked: np.ndarray, train: np.ndarray, k: int, apart: np.ndarray | None) -> np.ndarray:
    """Pairs that can be among the k nearest of each asked row, by products instead of differences, with slack for their rounding."""
    squares, own = (train * train).sum(axis=1), (asked * asked).sum(axis=1)
    rough = squares - 2 * (asked @ train.T)
    if apart is not None:
        rough[apart] = np.inf
    last = min(k, len(train)) - 1
    slack = 8 * (train.shape[1] + 8) * np.finfo(float).eps * (own + np.nanmax(squares, initial=0.0))
    return (rough <= np.partition(rough, last, axis=1)[:, last, None] + slack[:, None]) & (rough < np.inf)


def _matrix(features: pa.ChunkedArray, size: int) -> np.ndarray:
    return features.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _shards_udf(index: Index, k: int, first: np.ndarray, last: np.ndarray):
    """Shards that hold one of the cells a query touches."""
    @F.pandas_udf("array<int>")
    def shards(vectors: pd.Series, radius: pd.Series) -> pd.Series:
        def of(cells: np.ndarray) -> np.ndarray:
            opened = np.bincount(first[cells], minlength=last.max() + 2) - np.bincount(last[cells] + 1, minlength=last.max() + 2)
            return np.flatnonzero(opened.cumsum() > 0).astype("int32")

        return pd.Series([of(cells) for cells in touched_cells(np.stack(vectors.to_list()), radius.to_numpy(float), k, index)])
    return shards


def _best_of_blocks(k: int, size: int, query_features: str, schema: pa.Schema, apart: bool):
    """The k best train rows of every query of a block of queries and a block of train rows."""
    def best(queries: pa.Table, train: pa.Table) -> pa.Table:
        if not queries.num_rows or not train.num_rows:
            return schema.empty_table()
        ids = train["t_id"].combine_chunks()
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))  # ties go to the smaller id
        asked, held = _matrix(queries[query_features], size), _matrix(train["t_features"], size)
        middle = held.mean(axis=0)
        if apart:
            both = pa.chunked_array([*queries["q_apart"].chunks, *train["t_apart"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            mine, theirs = both[:len(asked)], both[len(asked):]
        picks, rows, gaps, ranks = [], [], [], []
        step = max(1, PAIRS // len(held))
        for at in range(0, len(asked), step):
            some = asked[at:at + step]
            near = _rough_best(some - middle, held - middle, k, mine[at:at + step, None] == theirs if apart else None)
            q, t = np.nonzero(near)
            gap = np.sqrt(((held[t] - some[q]) ** 2).sum(axis=1))
            order = np.lexsort((place[t], gap, q))
            q, t, gap = q[order], t[order], gap[order]
            rank = np.arange(len(q)) - np.searchsorted(q, q)
            keep = rank < k
            picks.append(q[keep] + at), rows.append(t[keep]), gaps.append(gap[keep]), ranks.append(rank[keep] + 1)
        picks, rows = np.concatenate(picks), np.concatenate(rows)
        found = [queries["__q"].take(picks), train["t_id"].take(rows), pa.array(np.concatenate(gaps)), pa.array(np.concatenate(ranks))]
        found += [train[n].take(rows) for n in train.column_names if n.startswith("c_")]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(found, schema)], schema=schema)
    return best


class Search(NamedTuple):
    """Tables of a search: queries, one row of each distinct query with the cell it starts from, cells visited beyond it (computed when read), and the best rows found."""
    queries: DataFrame
    asked: DataFrame
    visits: DataFrame
    best: DataFrame
    cells: int

    def visited_share(self) -> float:
        """Mean share of the cells that a query visits."""
        return (1 + self.visits.count() / max(self.asked.count(), 1)) / self.cells


def _index_of(points: DataFrame, features: str, classes: Sequence[str]) -> tuple[DataFrame, Index]:
    """Points with ``__cell``, and the index over them."""
    n = points.count()
    if n == 0:
        raise ValueError("the training set is empty")
    by_draw = draw(0, F.array_join(F.transform(features, lambda x: x.cast("string")), ","))
    size = points.select(F.size(features)).first()[0]
    wanted = max(8, min(math.ceil(math.sqrt(n)), PIVOT_BYTES // (8 * size)))
    drawn = points.select(features).distinct().orderBy(by_draw).limit(wanted).collect()
    centres, pivots, first = _grouped(np.array([r[0] for r in drawn], dtype=float))
    points = staged(points.withColumn("__at", _home_udf(centres, pivots, first)(col(features))).withColumn("__cell", F.col("__at.cell")))
    held, largest, greatest = (np.zeros(len(pivots)) for _ in range(3))
    least, spread = np.full(len(pivots), np.inf), np.zeros(len(centres))
    owner = np.repeat(np.arange(len(centres)), np.diff(first))
    # At most one row per pivot and class of ``apart``.
    for r in points.groupBy("__cell", *classes).agg(F.count(F.lit(1)).alias("n"), F.min("__at.gap").alias("least"), F.max("__at.gap").alias("greatest"),
                                                    F.max("__at.spread").alias("spread")).collect():
        i = r["__cell"]
        held[i] += r["n"]
        largest[i] = max(largest[i], r["n"])
        least[i], greatest[i] = min(least[i], r["least"]), max(greatest[i], r["greatest"])
        spread[owner[i]] = max(spread[owner[i]], r["spread"])
    # A cell's largest class may be the excluded one, so it does not count for what a query surely sees.
    return points.drop("__at"), Index(centres, pivots, first, held, held - largest if classes else held, least, greatest, spread)


def search(queries: DataFrame, train: DataFrame, k: int, query_id: str, train_id: str, features: str = "features", carry: Sequence[str] = (),
           apart: str | None = None) -> Search:
    """The tables behind ``nearest_neighbours``."""
    classes = [apart] if apart else []
    # Of equal vectors only the k smallest ids can be neighbours; the limit applies before the shuffle.
    points = train.select(train_id, features, *dict.fromkeys([*carry, *classes]))
    points = staged(first_k(points, [features, *classes], [train_id], k, "__r").drop("__r"))
    queries = staged(queries.select(query_id, features, *classes))
    points, index = _index_of(points, features, classes)
    at = _home_udf(index.centres, index.pivots, index.first)(col(features))
    asked = staged(queries.groupBy(features, *classes).agg(F.min(query_id).alias("__q")).withColumn("__cell", at["cell"]))

    def kind(df: DataFrame, name: str) -> str:
        return df.schema[name].dataType.simpleString()

    names = T._parse_datatype_string(", ".join([f"`__q` {kind(queries, query_id)}", f"train {kind(train, train_id)}", "distance double", "rank int",
                                                *[f"carry_{i} {kind(train, c)}" for i, c in enumerate(carry)]]))
    size = index.pivots.shape[1]
    best_of = _best_of_blocks(k, size, features, to_arrow_schema(names, prefers_large_types=False), bool(apart))
    held = points.select("__cell", col(train_id).alias("t_id"), col(features).alias("t_features"), *[col(c).alias(f"c_{i}") for i, c in enumerate(carry)],
                         *([col(apart).alias("t_apart")] if apart else []))
    own = [col(apart).alias("q_apart")] if apart else []

    def meet(sent: DataFrame, shown: DataFrame, groups: int) -> DataFrame:
        """The k best rows that the queries of a group find among its train rows."""
        by_group = lambda df: df.repartition(groups, "__group").groupBy("__group")
        return by_group(sent.select("__group", "__q", features, *own)).cogroup(by_group(shown.drop("__cell"))).applyInArrow(best_of, names)

    # A first look at a bounded part of the home cell gives the distance of a k-th row, where it holds k.
    rows, width = int(index.held.sum()), shuffle_width(queries.sparkSession)
    parts = F.get(F.lit(np.ceil(index.held / TRAIN_BLOCK).astype(int).tolist()), "__cell")
    slices = staged(asked.groupBy("__cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("__slices")))
    group = lambda at: F.struct("__cell", at.alias("slice"))
    at_home = asked.join(slices, "__cell").withColumn("__group", group(F.pmod(F.xxhash64("__q"), F.col("__slices")).cast("int")))
    some = (held.where(F.pmod(F.xxhash64("t_id"), parts) == 0).join(slices, "__cell")
            .withColumn("__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))).withColumn("__group", group(F.col("__slice"))).drop("__slice", "__slices"))
    radius = meet(at_home, some, width).groupBy(F.col("__q").alias("__p")).agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("__radius"))
    known = staged(asked.join(radius, F.col("__q") == F.col("__p"), "left").withColumn("__radius", F.coalesce("__radius", F.lit(float("nan")))).drop("__p"))
    touched = _touched_udf(index, k)(col(features), F.col("__radius"))
    visits = known.withColumn("__other", F.explode(touched)).where("__other <> __cell").select("__q", F.col("__other").alias("__cell"))

    # Runs of cells make shards of the train rows; a query goes to the shards that hold a cell it touches.
    asking = known.count()
    shards, blocks = _grid(rows, asking, 8 * size + 16, k, min(width, GRID))
    first, last = _shards_of(index.held, shards)
    at = lambda ends: F.get(F.lit(ends.tolist()), "__cell")
    spread = at(first) + F.pmod(F.xxhash64("t_id"), at(last) - at(first) + 1).cast("int")
    sent = known.withColumn("__shard", F.explode(_shards_udf(index, k, first, last)(col(features), F.col("__radius"))))
    sent = sent.withColumn("__group", F.col("__shard") * blocks + F.pmod(F.xxhash64("__q"), F.lit(blocks)).cast("int"))
    dealt = held.withColumn("__group", F.explode(F.sequence(spread * blocks, spread * blocks + blocks - 1)))
    found = meet(sent, dealt, shards * blocks)
    best = found if shards == 1 else keep_nearest(found, "__q", "train", k)
    return Search(queries, asked, visits, best, int((index.held > 0).sum()))


def _grid(rows: int, asking: int, row_bytes: int, k: int, wanted: int) -> tuple[int, int]:
    """Shards of the train rows and blocks of the queries: about ``wanted`` pairs of them, with the fewest bytes copied and found, none over ``BLOCK_BYTES``."""
    even = math.sqrt(wanted * rows * row_bytes / max(1, asking * (row_bytes + 24 * k)))
    shards = max(1, min(round(even), wanted, -(-rows // TRAIN_BLOCK)), -(-rows * row_bytes // BLOCK_BYTES))
    return shards, max(1, min(-(-wanted // shards), -(-asking // QUERY_BLOCK)), -(-asking * row_bytes // BLOCK_BYTES))


def _shards_of(held: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last shard of each cell: shards of even size along the order of the cells."""
    ends = held.cumsum()
    size = max(1.0, ends[-1] / shards)
    first = np.minimum((ends - held) // size, shards - 1)
    return first.astype(int), np.maximum(first, np.minimum((ends - 1) // size, shards - 1)).astype(int)


def nearest_neighbours(queries: DataFrame, train: DataFrame, k: int, query_id: str, train_id: str,
                       features: str = "features", carry: Sequence[str] = (), apart: str | None = None) -> DataFrame:
    """Rows (query_id, train_id, carried columns, distance, rank 1..k); ties go to the smaller id.

    ``features`` are arrays of doubles without nulls. ``apart`` names a column both sides hold: rows
    with the same value are never neighbours. When both ids have one name, the query's comes out as
    ``query_<name>``.
    """
    classes = [apart] if apart else []
    found = search(queries, train, k, query_id, train_id, features, carry, apart)
    out_id = query_id if query_id != train_id else f"query_{query_id}"
    named = found.queries.join(found.asked.drop("__cell"), [features, *classes]).select(col(query_id).alias(out_id), "__q")
    return named.join(found.best, "__q").select(out_id, F.col("train").alias(train_id),
                                                *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)], "distance", "rank")


def keep_nearest(found: DataFrame, query_id: str, train_id: str, k: int) -> DataFrame:
    """Rank the candidates of every query and keep k of them."""
    return first_k(found.drop("rank"), [query_id], ["distance", train_id], k)


def nearest_distances(df: DataFrame, id_column: str, columns: Sequence[str], k: int) -> DataFrame:
    """Euclidean distances of every row to its k nearest other rows."""
    rows = staged(drop_null_rows(df, columns).select(id_column, feature_array(columns).alias("features")))
    found = nearest_neighbours(rows, rows, k + 1, id_column, id_column)
    mine = f"query_{id_column}"
    others = found.where(col(mine) != col(id_column))
    return keep_nearest(others, mine, id_column, k).select(
        F.col(mine).alias("id_a"), F.col(id_column).alias("id_b"), "distance", "rank")


def majority(votes: DataFrame, query_id: str, vote: str) -> DataFrame:
    """Most frequent vote per query; a tie goes to the smaller label."""
    counts = votes.groupBy(query_id, vote).agg(F.count(F.lit(1)).alias("__votes"))
    return counts.groupBy(query_id).agg(F.min_by(col(vote), F.struct(-F.col("__votes"), col(vote))).alias("predicted"))


def classify_knn(train: DataFrame, test: DataFrame, id_column: str, label: str, columns: Sequence[str],
                 k: int = 5) -> DataFrame:
    """Majority vote of the k nearest training rows; a tied vote goes to the smaller label."""
    train, test = drop_null_rows(train, columns), drop_null_rows(test, columns)
    a = train.select(F.col(id_column).alias("train_id"), col(label), feature_array(columns).alias("features"))
    test = staged(test.select(id_column, label, feature_array(columns).alias("features")))
    won = majority(nearest_neighbours(test, a, k, id_column, "train_id", carry=[label]), id_column, label)
    return test.select(id_column, F.col(label).alias("actual")).join(won, id_column, "left")


def knn_tune(df: DataFrame, id_column: str, label: str, columns: Sequence[str], ks: Sequence[int], folds: int = 10,
             seed: int = 0) -> DataFrame:
    """Cross-validated accuracy per k; neighbours are ranked once, up to the largest k.

    Folds keep the label proportions. Running vote counts over the ranks give the prediction of every k:
    the most votes reached so far, the smaller label on a tie.
    """
    complete = drop_null_rows(df, [label, *columns])
    folded = staged(shuffled_position(complete, [label], [id_column], seed, "__pos")
                    .select(id_column, label, feature_array(columns).alias("features"),
                            F.pmod("__pos", F.lit(folds)).cast("int").alias("fold")))
    train = folded.select(F.col(id_column).alias("train_id"), F.col(label).alias("vote"), "features", "fold")
    found = nearest_neighbours(folded, train, max(ks), id_column, "train_id", carry=["vote"], apart="fold")
    labels = [r[0] for r in folded.select(label).distinct().orderBy(label).collect()]
    place = F.array_position(F.lit(labels), F.col("vote")).cast("int")
    running = (found.withColumn("__votes", F.row_number().over(Window.partitionBy(id_column, "vote").orderBy("rank")))
               .withColumn("__best", F.max(F.struct("__votes", (-place).alias("place"))).over(
                   Window.partitionBy(id_column).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
               .where(F.col("rank").isin([int(x) for x in ks]))
               .select(id_column, F.col("rank").alias("k"),
                       F.element_at(F.lit(labels), -F.col("__best.place")).alias("predicted")))
    scored = (running.join(folded.select(id_column, label, "fold"), id_column)
              .groupBy("k", "fold").agg(F.avg((col(label) == F.col("predicted")).cast("double")).alias("a")))
    return (scored.groupBy("k").agg(F.avg("a").alias("accuracy"), F.stddev_samp("a").alias("accuracy_sd"),
                                    F.count(F.lit(1)).alias("folds"))
            .orderBy("k"))


def best_k(tuned: DataFrame) -> DataFrame:
    """The k with the best accuracy; the smallest one on a tie."""
    return tuned.orderBy(F.desc("accuracy"), "k").limit(1)
