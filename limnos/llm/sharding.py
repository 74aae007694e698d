"""Shards by rendezvous hashing (SQL functions only).

Every pair of record key and shard name gets a uniform draw u in (0, 1) from a digest; the record goes to the shard with
the smallest ``-ln(u) / weight``. A new shard has draws of its own, so it takes rows only into itself, and a share equal to its part
of the total weight; rows never move between old shards.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from limnos.functions.nulls import col
from limnos.llm.shared import shuffle_partitions
from limnos.session import staged

#: Rows one numbering slice of a shard holds on average.
SLICE_ROWS = 50_000


def unit_draw(text: Column) -> Column:
    """Uniform draw in (0, 1) from the first 52 bits of a digest."""
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double")
    return (bits + 0.5) / float(2 ** 52)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """Shard of a key among weighted shards (name to positive weight); a null key counts as the text 'null'."""
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive, and at least one")
    text = F.coalesce(key.cast("string"), F.lit("null"))
    cost = [F.struct((-F.log(unit_draw(F.concat_ws(":", text, F.lit(str(s))))) / float(w)).alias("cost"), F.lit(s).alias("shard"))
            for s, w in sorted(weights.items())]
    return F.array_min(F.array(*cost))["shard"] if len(cost) > 1 else F.lit(next(iter(weights)))


def shard_documents(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row for each document.

    ``size`` is the UTF-8 bytes of the text plus one (a null text has no bytes), ``text_crc32`` the checksum of those
    bytes (of none for a null text). Key and shards alone decide ``shard``, and ``grown_shard`` with the shards of ``grown``, so equal
    texts under different ids may part. ``slot`` numbers the rows of a shard 0, 1, 2 ... in the order of a digest of id
    and checksum, then id, checksum and size.

    Texts, however long, are read once and never shuffled. Equal rows are first counted into one, so a repeated row, however hot, is
    one row of a slice; slices of a shard are numbered by themselves and moved by the rows before them. Null ids
    share the shard of the key 'null'. An empty table gives an empty result; columns beyond the two are not read.
    """
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    narrow = docs.select(col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    key = F.col("doc_id")
    spot = unit_draw(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), F.col("text_crc32").cast("string")))
    counted = staged(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
                     .select("*", rendezvous(key, weights).alias("shard"), rendezvous(key, grown).alias("grown_shard"), spot.alias("spot")))
    rows = counted.agg(F.sum("n")).first()[0] or 0
    # As many slices as the rows need, at least as many in all as a shuffle has partitions.
    slices = max(1, rows // (SLICE_ROWS * len(weights)), 4 * shuffle_partitions(docs.sparkSession) // len(weights))
    sliced = counted.withColumn("slice", F.floor(F.col("spot") * slices).cast("long"))
    runs = sliced.groupBy("shard", "slice").agg(F.sum("n").alias("rows"))
    before = (runs.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("slice")) - F.col("rows"))
              .drop("rows"))
    inside = Window.partitionBy("shard", "slice").orderBy("spot", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = (sliced.withColumn("first", F.sum("n").over(inside) - F.col("n")).join(before, ["shard", "slice"])
                .withColumn("first", F.col("first") + F.col("before")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
                           F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"),
                           F.col("grown_shard").cast("int").alias("grown_shard"))
