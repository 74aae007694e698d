"""Helpers of the text operators: row maps over whole texts, repeatable samples, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from limnos.functions.nulls import col
from limnos.session import staged

#: Bytes of text a task works on at once; a longer text is in a slice of its own.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, position: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Runs of rows whose texts end in the same ``SLICE_BYTES`` of the batch, and those texts; no others become Python objects."""
    sizes = pc.fill_null(pc.binary_length(batch.column(position)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for start, end in zip(bounds, bounds[1:]):
        if start < end:
            part = batch.slice(start, end - start)
            yield part, part.column(position).to_pylist()


def map_texts(df: DataFrame, text: str, keep: dict[str, str], make: Callable[[], Callable[[list[str | None]], dict[str, pa.Array]]],
              added: str) -> DataFrame:
    """Columns computed from whole texts, beside some columns of the input.

    ``keep`` maps output names to input columns, ``added`` is the schema of the computed columns. ``make`` runs once in
    a task and returns the function that turns the texts of a slice into those columns. Rows stay in their partition.
    """
    extra = T._parse_datatype_string(added)
    kept = df.select(col(text).cast("string").alias("__text"), *[col(c).alias(n) for n, c in keep.items()])
    schema = T.StructType([*kept.schema.fields[1:], *extra.fields])
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for part, texts in text_slices(batch, 0):
                out = compute(texts)
                columns = [part.column(1 + i) for i in range(len(names))] + [out[f.name] for f in extra.fields]
                yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, arrow)], schema=arrow)

    return kept.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str | None]], np.ndarray]]) -> DataFrame:
    """The rows whose text a function says to keep; all columns, whatever their names, pass through."""
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = make()
        for batch in batches:
            for part, texts in text_slices(batch, position):
                yield part.filter(pa.array(choose(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Documents to learn from: the id is known and not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def sample_per_class(rows: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """About ``size`` rows of each label, drawn by a hash of the key: bounded, and the same on every run.

    The label counts are one aggregate. A row stays if its hash lies in the first ``size / count`` of the range, so no
    label is sorted or gathered. Adds ``__weight``, the rows of the label that each drawn row stands for.
    """
    counts = staged(rows.groupBy(col(label).alias("__label")).agg(F.count(F.lit(1)).alias("__n")))
    share = F.least(F.lit(1.0), F.lit(float(size)) / F.col("__n"))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), col(key)), 11).cast("double") / float(2 ** 53)
    return (rows.join(counts, col(label) == F.col("__label"))
            .where(spot < share).withColumn("__weight", 1.0 / share).drop("__label", "__n"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node each node of the undirected edges (a, b) is connected with.

    Alternating large-star and small-star steps: an edge list that only shrinks towards stars, in a number of rounds that
    grows with the logarithm of the nodes. Each round is one aggregate and one join per step, both written to the shared
    folder, so that the edges of a hub are a join that adaptive execution can split; only a count and a checksum reach the driver. No loops (a = b) and no nulls are expected.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
        large = (both.join(low, both["a"] == low["u"]).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        large = staged(large)
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m"))
        small = (large.join(low, large["a"] == low["u"])
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                 .distinct())
        now = staged(small)
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def numbered_in_place(rows: DataFrame, out: str, first: int = 0) -> DataFrame:
    """Rows numbered from ``first`` in the order of their partitions and of the rows in them, as a written table.

    A row's place in its partition is shifted by the rows of the partitions before: one number per partition is all that is gathered.
    """
    placed = staged(rows.withColumn("__seq", F.monotonically_increasing_id()))
    part, row = F.shiftright("__seq", 33), F.col("__seq").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    shift = staged(counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before")))
    return placed.withColumn("__part", part).join(shift, "__part").withColumn(out, F.col("__before") + row + first).drop("__part", "__seq", "__before")


def one_of_each(docs: DataFrame, names: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the smallest id, null last, then the smallest hash of its text.

    ``names`` has ``doc_id``, ``hash`` (of the text) and ``fp`` of each document, ``classes`` the ``root`` of each ``fp``. Texts are
    not shuffled: the row to keep is named by id and text hash and found by a semi join, which adaptive execution
    splits where one key is hot. Only where several equal rows carry the chosen name are those rows made distinct.
    """
    name = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")
    least = names.groupBy("fp").agg(F.min(name).alias("name"))
    chosen = least.join(classes, "fp").groupBy("root").agg(F.min("name").alias("name")).select("name.doc_id", "name.hash")
    rows = names.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    mine = "__one"
    while any(c.startswith(mine) for c in docs.columns):
        mine += "_"
    chosen = staged(chosen.alias("c").join(rows.alias("r"), F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.hash") == F.col("r.hash")))
                    .select(F.col("c.doc_id").alias(mine + "i"), F.col("c.hash").alias(mine + "h"), F.col("n").alias(mine + "n")))
    match = col(doc_id).eqNullSafe(col(mine + "i")) & (F.xxhash64(col(text)) == col(mine + "h"))
    once = docs.join(chosen.where(col(mine + "n") == 1), match, "left_semi")
    repeated = docs.join(chosen.where(col(mine + "n") > 1), match, "left_semi").dropDuplicates([doc_id, text])
    return once.unionByName(repeated)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
