"""Every label has a pivot, also when chance draws none."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.llm import embedding_dedup


def test_a_label_whose_vectors_are_not_drawn_has_a_pivot(spark):
    numbers = F.array(*[((F.col("id") * f) % 97 + 1).cast("double") for f in (3, 7, 11, 13)])
    rows = spark.range(400).select(F.col("id").alias("vec_id"), numbers.alias("embedding"), F.lit(1).alias("label")).dropDuplicates(["embedding"])
    name = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), "label", "embedding")), 16, "0") for seed in (1, 2)])
    spot = F.shiftrightunsigned(F.xxhash64(name), 11).cast("double") / float(2 ** 53)
    late = rows.where(spot > 0.5).orderBy("vec_id").limit(30)  # 9 in 30 are drawn by chance
    assert late.count() == 30
    found = embedding_dedup.similar_vectors(late)
    assert found.count() == 30 and found.where("n_links is null or component_id is null").count() == 0


def test_extreme_magnitudes_link_by_direction(spark):
    rows = [(1, [1e-200, 1e-200]), (2, [0.1, 1.0]), (3, [1e200, 1e200]), (4, [1e200, 1.01e200]), (5, [5e-324, 5e-324])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.similar_vectors(table).collect()}
    assert got == {1: (3, 1), 2: (0, 2), 3: (3, 1), 4: (3, 1), 5: (3, 1)}
