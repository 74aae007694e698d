"""2.14 Tests, scaling, imputation, sampling, splits and feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog import sql_text
from limnos.catalog.registry import TARGETS, aggregated, meas, merged, query, sites
from limnos.functions.nulls import col
from limnos.operators import features as ft
from limnos.operators import stat_tests as st
from limnos.operators.columns import derive_period
from limnos.operators.joins import priority_dedupe_sites
from limnos.operators.reshape import site_target_matrix
from limnos.plans import europe, seasons, swiss
from limnos.sources.driver_tables import table

_K2 = """
WITH g AS (SELECT wb_code, target, avg(value) AS mu FROM m WHERE value IS NOT NULL GROUP BY ALL),
c AS (SELECT wb_code, target, CAST(count(*) AS DOUBLE) AS n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3,
  avg((value - mu) ** 4) AS m4 FROM m JOIN g USING (wb_code, target) WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT *, m3 / m2 ** 1.5e0 AS g1, m4 / m2 ** 2 AS b2 FROM c),
a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  sqrt(2 * (3 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
  6 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM k),
d AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS ya, 6 + 8 / s * (2 / s + sqrt(1 + 4 / s ** 2)) AS aa FROM a),
e AS (SELECT *, ln(ya + sqrt(ya * ya + 1)) / sqrt(0.5e0 * ln(w2)) AS z1, 1 + x * sqrt(2 / (aa - 4)) AS dd FROM d),
f AS (SELECT *, ((1 - 2 / (9 * aa)) - sign(dd) * cbrt((1 - 2 / aa) / abs(dd))) / sqrt(2 / (9 * aa)) AS z2 FROM e)
SELECT wb_code, target, CAST(n AS BIGINT) AS n, R(g1) AS skewness, R(b2) AS kurtosis, R(z1*z1 + z2*z2) AS k2,
  R(exp(-(z1*z1 + z2*z2) / 2)) AS p, exp(-(z1*z1 + z2*z2) / 2) < 0.001e0 AS reject_normal FROM f"""


@query("normality_dagostino", _K2, digits=3)
def normality_dagostino(spark, folder):
    return st.normality_dagostino(meas(spark, folder), ["wb_code", "target"])


_A1 = sql_text.polynomial("root", (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056))
_A2 = sql_text.polynomial("root", (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
_MU = sql_text.polynomial("ln(n)", (-1.5861, -0.31082, -0.083751, 0.0038915))
_SIGMA = sql_text.polynomial("ln(n)", (-0.4803, -0.082676, 0.0030302))


@query("normality_shapiro", f"""
WITH d AS (SELECT wb_code, value, sample_id FROM m WHERE value IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY wb_code ORDER BY value, sample_id) AS i,
  CAST(count(*) OVER (PARTITION BY wb_code) AS DOUBLE) AS n FROM d),
z AS (SELECT *, (i - 0.375e0) / (n + 0.25e0) AS u FROM o), q AS (SELECT *, {sql_text.normal_quantile('u')} AS s FROM z),
g AS (SELECT wb_code, n, 1 / sqrt(n) AS root, sum(s * s) AS mm, max(s) AS m1, max(s) FILTER (i = n - 1) AS m2, var_pop(value) * n AS ss FROM q GROUP BY wb_code, n),
w AS (SELECT *, {_A1} + m1 / sqrt(mm) AS a1, {_A2} + m2 / sqrt(mm) AS a2 FROM g),
f AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM w),
l AS (SELECT wb_code, f.n, ss, sum(value * CASE WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 WHEN i = f.n THEN a1 WHEN i = f.n - 1 THEN a2
  ELSE s / phi END) AS b FROM q JOIN f USING (wb_code) GROUP BY wb_code, f.n, ss),
r AS (SELECT wb_code, n, b * b / ss AS w, (ln(1 - b * b / ss) - {_MU}) / exp({_SIGMA}) AS z FROM l)
SELECT wb_code, CAST(n AS BIGINT) AS n, R(w) AS w, R(CASE WHEN z < 0 THEN 1 - {sql_text.two_sided_p('z')} / 2 ELSE {sql_text.two_sided_p('z')} / 2 END) AS p FROM r""")
def normality_shapiro(spark, folder):
    return st.normality_shapiro(meas(spark, folder), ["wb_code"], "sample_id")


@query("wilcoxon_signed_rank", f"""
WITH e AS (SELECT target, site_id, year, avg(value) FILTER (season = 'summer') AS a, avg(value) FILTER (season = 'winter') AS b
  FROM mp WHERE value IS NOT NULL AND season IN ('summer', 'winter') GROUP BY ALL),
c AS (SELECT target, count(*) FILTER (a = b) AS same, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM e GROUP BY target),
d AS (SELECT target, a - b AS d FROM e WHERE a <> b),
r AS (SELECT target, d, rank() OVER (PARTITION BY target ORDER BY abs(d))
  + (count(*) OVER (PARTITION BY target, abs(d)) - 1) / 2.0e0 AS r,
  CAST(count(*) OVER (PARTITION BY target, abs(d)) AS DOUBLE) AS t FROM d),
s AS (SELECT target, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS v, sum((t*t*t - t) / t) AS ties FROM r GROUP BY target),
q AS (SELECT *, v - CAST(n AS DOUBLE) * (n + 1) / 4 AS shift,
  sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM s),
z AS (SELECT *, (shift - sign(shift) * 0.5e0) / sd AS z FROM q)
SELECT target, coalesce(n, 0) AS n_pairs, same AS n_equal_pairs, only_a AS n_only_first, only_b AS n_only_second,
  R(v) AS v, R(z) AS z, R({sql_text.two_sided_p('z')}) AS p FROM c LEFT JOIN z USING (target)""")
def wilcoxon_signed_rank(spark, folder):
    """Mean of the summer against mean of the winter, site by site and year by year."""
    return st.wilcoxon_signed_rank(derive_period(meas(spark, folder), "sampled_on"), ["target"], ["site_id", "year"])


@query("mann_whitney", f"""
WITH o AS (SELECT target, wb_code, value, rank() OVER (PARTITION BY target ORDER BY value)
  + (count(*) OVER (PARTITION BY target, value) - 1) / 2.0e0 AS r,
  CAST(count(*) OVER (PARTITION BY target, value) AS DOUBLE) AS t FROM m WHERE value IS NOT NULL AND wb_code IN ('GW', 'RW')),
s AS (SELECT target, count(*) FILTER (wb_code = 'GW') AS n_first, count(*) FILTER (wb_code = 'RW') AS n_second,
  sum(r) FILTER (wb_code = 'GW') AS rs, sum((t*t*t - t) / t) AS ties, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY target),
u AS (SELECT *, rs - CAST(n_first AS DOUBLE) * (n_first + 1) / 2 AS u, CAST(n_first AS DOUBLE) * n_second AS nn FROM s),
z AS (SELECT *, (u - nn / 2 - sign(u - nn / 2) * 0.5e0) / sqrt(nn / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM u)
SELECT target, n_first, n_second, R(u) AS u, R(z) AS z, R({sql_text.two_sided_p('z')}) AS p FROM z""")
def mann_whitney(spark, folder):
    return st.mann_whitney(meas(spark, folder), ["target"], "wb_code", "GW", "RW")


# Ways to reach each sum of positive ranks, by size, and the summer and winter means of a site and year.
_LAW = """law AS (WITH RECURSIVE l(n, c) AS (SELECT 0, [1e0] UNION ALL
  SELECT n + 1, [coalesce(c[s + 1], 0) + CASE WHEN s > n THEN c[s - n] ELSE 0 END FOR s IN range(0, len(c) + n + 1)] FROM l WHERE n < 49)
  SELECT n, [list_sum(c[1:k]) / 2 ** n FOR k IN range(1, len(c) + 1)] AS law FROM l WHERE n > 0)"""
_SEASONS = """e AS (SELECT target, site_id, year, avg(value) FILTER (season = 'summer') AS a, avg(value) FILTER (season = 'winter') AS b
  FROM mp WHERE value IS NOT NULL AND season IN ('summer', 'winter') GROUP BY ALL)"""


def _interval_sql(keys: str) -> str:
    return f"""
WITH {_LAW}, {_SEASONS},
g AS (SELECT {keys}, abs(a - b) AS size, count(*) AS n FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
s AS (SELECT {keys}, CAST(sum(CASE WHEN size > 0 THEN n ELSE 0 END) AS BIGINT) AS n_pairs, max(n) = 1 AND min(size) > 0 AS clean FROM g GROUP BY ALL),
d AS (SELECT {keys}, a - b AS d, row_number() OVER (PARTITION BY {keys} ORDER BY a - b, site_id, year) AS i FROM e WHERE a <> b),
w AS (SELECT {keys}, (x.d + y.d) / 2 AS w, row_number() OVER (PARTITION BY {keys} ORDER BY (x.d + y.d) / 2) AS r, count(*) OVER (PARTITION BY {keys}) AS c
  FROM d x JOIN d y USING ({keys}) WHERE x.i <= y.i),
q AS (SELECT s.*, CAST(n_pairs AS DOUBLE) AS x, CASE WHEN clean AND law IS NOT NULL THEN greatest(1, len([p FOR p IN law IF p < 0.025e0])) END AS t FROM s LEFT JOIN law ON n_pairs = law.n),
k AS (SELECT * EXCLUDE (x, clean), greatest(1, floor(x * (x + 1) / 4 - 1.959963984540054e0 * sqrt(x * (x + 1) * (2 * x + 1) / 24))) AS f FROM q)
SELECT {keys}, n_pairs, R(avg(w) FILTER (r IN ((c + 1) // 2, c // 2 + 1))) AS estimate, R(max(w) FILTER (r = f)) AS ci_low, R(max(w) FILTER (r = c + 1 - f)) AS ci_high,
  R(max(w) FILTER (r = t)) AS exact_low, R(max(w) FILTER (r = c + 1 - t)) AS exact_high FROM k LEFT JOIN w USING ({keys}) GROUP BY {keys}, n_pairs"""


@query("wilcoxon_interval", _interval_sql("target"))
def wilcoxon_interval(spark, folder):
    """Median summer-winter difference of a target, with its 95 % interval."""
    return st.signed_rank_interval(derive_period(meas(spark, folder), "sampled_on"), ["target"], ["site_id", "year"])


@query("wilcoxon_interval_sites", _interval_sql("target, site_id"))
def wilcoxon_interval_sites(spark, folder):
    """The same for each site, where there are few years."""
    return st.signed_rank_interval(derive_period(meas(spark, folder), "sampled_on"), ["target", "site_id"], ["year"])


@query("wilcoxon_exact", f"""
WITH {_LAW}, {_SEASONS},
c AS (SELECT target, site_id, count(*) FILTER (a = b) AS same, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM e GROUP BY ALL),
d AS (SELECT target, site_id, a - b AS d FROM e WHERE a <> b),
r AS (SELECT target, site_id, d, rank() OVER (PARTITION BY target, site_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY target, site_id, abs(d)) - 1) / 2.0e0 AS r,
  CAST(count(*) OVER (PARTITION BY target, site_id, abs(d)) AS DOUBLE) AS t FROM d),
s AS (SELECT target, site_id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS v, sum((t*t*t - t) / t) AS ties FROM r GROUP BY ALL),
q AS (SELECT *, v - CAST(n AS DOUBLE) * (n + 1) / 4 AS shift, sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS sd FROM s),
z AS (SELECT *, (shift - sign(shift) * 0.5e0) / sd AS z FROM q)
SELECT target, site_id, coalesce(z.n, 0) AS n_pairs, same AS n_equal_pairs, only_a AS n_only_first, only_b AS n_only_second, R(v) AS v, R(z) AS z, R({sql_text.two_sided_p('z')}) AS p,
  R(CASE WHEN same = 0 AND ties = 0 AND law IS NOT NULL THEN least(2 * law[CAST(least(v, z.n * (z.n + 1) / 2 - v) AS BIGINT) + 1], 1) END) AS p_exact
FROM c LEFT JOIN z USING (target, site_id) LEFT JOIN law ON law.n = z.n""")
def wilcoxon_exact(spark, folder):
    """Summer against winter at each site, with the exact law of a small sample."""
    return st.signed_rank_exact(derive_period(meas(spark, folder), "sampled_on"), ["target", "site_id"], ["year"])


@query("mann_whitney_exact", f"""
WITH o AS (SELECT target, country, year, wb_code, value, rank() OVER (PARTITION BY target, country, year ORDER BY value)
  + (count(*) OVER (PARTITION BY target, country, year, value) - 1) / 2.0e0 AS r,
  CAST(count(*) OVER (PARTITION BY target, country, year, value) AS DOUBLE) AS t FROM me WHERE value IS NOT NULL AND wb_code IN ('ground', 'river')),
s AS (SELECT target, country, year, count(*) FILTER (wb_code = 'ground') AS n_first, count(*) FILTER (wb_code = 'river') AS n_second,
  coalesce(sum(r) FILTER (wb_code = 'ground'), 0) AS rs, sum((t*t*t - t) / t) AS ties, CAST(count(*) AS DOUBLE) AS n FROM o GROUP BY ALL),
u AS (SELECT *, rs - CAST(n_first AS DOUBLE) * (n_first + 1) / 2 AS u, CAST(n_first AS DOUBLE) * n_second AS nn FROM s),
z AS (SELECT *, (u - nn / 2 - sign(u - nn / 2) * 0.5e0) / nullif(sqrt(nn / 12 * ((n + 1) - coalesce(ties / nullif(n * (n - 1), 0), 0))), 0) AS z FROM u),
law AS (WITH RECURSIVE l(a, b, i, c) AS (
  SELECT n_first, n_second, 0, list_prepend(1e0, [0e0 FOR s IN range(0, n_first * n_second)]) FROM (
    SELECT DISTINCT n_first, n_second FROM s WHERE n_first BETWEEN 1 AND 49 AND n_second BETWEEN 1 AND 49)
  UNION ALL SELECT a, b, i + 1, [list_sum([c[s - j * (i + 1) + 1] - CASE WHEN s - j * (i + 1) > b + i THEN c[s - j * (i + 1) - b - i] ELSE 0 END
    FOR j IN range(0, s // (i + 1) + 1)]) FOR s IN range(0, len(c))] FROM l WHERE i < a)
  SELECT a, b, c, list_sum(c) AS total FROM l WHERE i = a)
SELECT target, country, year, n_first, n_second, R(u) AS u, R(z) AS z, R({sql_text.two_sided_p('z')}) AS p,
  R(CASE WHEN ties = 0 AND total IS NOT NULL THEN least(2 * list_sum(c[1:CAST(least(u, nn - u) AS BIGINT) + 1]) / total, 1) END) AS p_exact
FROM z LEFT JOIN law ON n_first = a AND n_second = b""")
def mann_whitney_exact(spark, folder):
    """Ground water against rivers within a country and year, with the exact law of a small sample."""
    return st.rank_sum_exact(merged(spark, folder), ["target", "country", "year"], "wb_code", "ground", "river")


@query("welch_t", """
WITH g AS (SELECT target, count(value) FILTER (wb_code = 'GW') AS n1, count(value) FILTER (wb_code = 'RW') AS n2,
  avg(value) FILTER (wb_code = 'GW') AS m1, avg(value) FILTER (wb_code = 'RW') AS m2,
  var_samp(value) FILTER (wb_code = 'GW') / count(value) FILTER (wb_code = 'GW') AS e1,
  var_samp(value) FILTER (wb_code = 'RW') / count(value) FILTER (wb_code = 'RW') AS e2 FROM m GROUP BY target)
SELECT target, n1, n2, R(m1) AS mean1, R(m2) AS mean2, R(m1 - m2) AS difference, R((m1 - m2) / sqrt(e1 + e2)) AS t,
  R((e1 + e2) ** 2 / (e1 ** 2 / (n1 - 1) + e2 ** 2 / (n2 - 1))) AS df FROM g""")
def welch_t(spark, folder):
    out = st.welch_t(meas(spark, folder), ["target"], "wb_code", "GW", "RW")
    return out.select("target", "n1", "n2", "mean1", "mean2", "difference", "t", "df")


@query("welch_t_interval")
def welch_t_interval(spark, folder):
    return st.welch_t(meas(spark, folder), ["target"], "wb_code", "GW", "RW")


def _year_matrix(spark, folder):
    return site_target_matrix(merged(spark, folder), TARGETS, ["site_id", "year"])


_WIDE = "w AS (SELECT site_id, year, " + ", ".join(f"avg(value) FILTER (target = '{t}') AS {t}" for t in TARGETS) + " FROM me GROUP BY ALL)"


def _each(form: str) -> str:
    return ", ".join(f"R({form.format(t=t)}) AS \"{t}\"" for t in TARGETS)


@query("scale_population", f"WITH {_WIDE} SELECT site_id, year, {_each('({t} - avg({t}) OVER ()) / stddev_pop({t}) OVER ()')} FROM w")
def scale_population(spark, folder):
    return ft.scale_population(_year_matrix(spark, folder), TARGETS)


@query("scale_sample", f"WITH {_WIDE} SELECT site_id, year, {_each('({t} - avg({t}) OVER ()) / stddev_samp({t}) OVER ()')} FROM w")
def scale_sample(spark, folder):
    return ft.scale_sample(_year_matrix(spark, folder), TARGETS)


@query("impute_zero", f"WITH {_WIDE} SELECT site_id, year, {_each('coalesce({t}, 0)')} FROM w")
def impute_zero(spark, folder):
    return ft.impute_zero(_year_matrix(spark, folder), TARGETS)


@query("impute_mean", f"WITH {_WIDE} SELECT site_id, year, {_each('coalesce({t}, avg({t}) OVER ())')} FROM w")
def impute_mean(spark, folder):
    return ft.impute_mean(_year_matrix(spark, folder), TARGETS)


_CELLS = f"(SELECT sum(x) / count(x) FROM (SELECT unnest([{', '.join(TARGETS)}]) AS x FROM w))"


@query("impute_global_mean", f"WITH {_WIDE} SELECT site_id, year, {_each('coalesce({t}, ' + _CELLS + ')')} FROM w")
def impute_global_mean(spark, folder):
    """A site without a target gets the mean over all pairs of site, year and target."""
    return ft.impute_global_mean(_year_matrix(spark, folder), TARGETS)


_VARIANCE_COLUMNS = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "mostly_zero", "constant")


def _variance_rows(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_tax", F.when(col("l_quantity") >= 50, 1).otherwise(0).alias("mostly_zero"),
        F.lit(1).alias("constant"))


@query("near_zero_variance", """
WITH v AS (SELECT l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_quantity >= 50 THEN 1 ELSE 0 END AS mostly_zero, 1 AS constant FROM lineitem),
c AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x, count(*) AS n FROM v GROUP BY {c}" for c in _VARIANCE_COLUMNS) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, x) AS r FROM c),
s AS (SELECT col, count(*) AS n_distinct, coalesce(max(n) FILTER (r = 1) / CAST(max(n) FILTER (r = 2) AS DOUBLE), 0) AS fr FROM r GROUP BY col)
SELECT col AS "column", n_distinct, R(fr) AS freq_ratio, R(n_distinct * 100.0e0 / (SELECT count(*) FROM v)) AS percent_unique,
  n_distinct <= 1 AS zero_variance,
  n_distinct <= 1 OR (fr > 4 AND n_distinct * 100.0e0 / (SELECT count(*) FROM v) <= 33) AS near_zero_variance FROM s""")
def near_zero_variance(spark, folder):
    return ft.variance_metrics(_variance_rows(spark, folder), _VARIANCE_COLUMNS)


@query("near_zero_variance_drop", "SELECT l_linenumber, R(l_quantity) AS l_quantity, R(l_discount) AS l_discount, R(l_tax) AS l_tax FROM lineitem")
def near_zero_variance_drop(spark, folder):
    return ft.near_zero_variance(_variance_rows(spark, folder), _VARIANCE_COLUMNS)


@query("select_targets_for_model", """
WITH k AS (SELECT * FROM aw WHERE below_loq_pct <= 30)
SELECT target, CAST(sum(n) AS BIGINT) AS n FROM k WHERE NOT regexp_matches(target, 'compounds|Other') GROUP BY target
HAVING count(DISTINCT wb_code) = (SELECT count(DISTINCT wb_code) FROM k) AND min(n) >= 50 ORDER BY n DESC, target LIMIT 4""")
def select_targets_for_model(spark, folder):
    return ft.targets_for_water_bodies(aggregated(spark, folder, "wb_code", "target"), 30, 50, 4)


@query("targets_in_every_category", """
SELECT target FROM me GROUP BY target HAVING count(DISTINCT rbd) = (SELECT count(DISTINCT rbd) FROM me)""")
def targets_in_every_category(spark, folder):
    return ft.targets_in_every_category(merged(spark, folder), "rbd")


@query("class_balance", "SELECT wb_code, count(*) AS n FROM me GROUP BY wb_code")
def class_balance(spark, folder):
    return ft.class_balance(merged(spark, folder), "wb_code")


@query("drop_small_classes", """
SELECT site_id, country FROM sd WHERE country IN (SELECT country FROM sd GROUP BY country HAVING count(*) >= 4)""")
def drop_small_classes(spark, folder):
    known = priority_dedupe_sites(sites(spark, folder)).select("site_id", "country")
    return ft.drop_small_classes(known, "country", 4)


def _placed(rows: str, label: str, key: str, seed: int) -> str:
    return (f"SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {sql_text.draw(seed, key)}, {key}) - 1 AS pos, "
            f"count(*) OVER (PARTITION BY {label}) AS size FROM {rows}")


@query("oversample", f"""
WITH p AS ({_placed('labels', 'quality', 'doc_id', 5)}), s AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality),
b AS (SELECT max(n) AS n FROM s),
d AS (SELECT quality, i, {sql_text.draw(6, 'quality', 'i')} % s.n AS pos FROM s, b, range(b.n) t(i) WHERE i < b.n - s.n)
SELECT doc_id, quality, toxic, CAST(0 AS BIGINT) AS copy FROM labels
UNION ALL SELECT p.doc_id, p.quality, p.toxic, d.i + 1 FROM d JOIN p ON p.quality = d.quality AND p.pos = d.pos""")
def oversample(spark, folder):
    return ft.oversample(table(spark, folder, "labels"), "quality", ["doc_id"], seed=5)


@query("undersample", f"""
WITH p AS ({_placed('labels', 'quality', 'doc_id', 5)})
SELECT doc_id, quality, toxic FROM p WHERE pos < (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def undersample(spark, folder):
    return ft.undersample(table(spark, folder, "labels"), "quality", ["doc_id"], seed=5)


@query("stratified_split", f"""
WITH p AS ({_placed('m', 'wb_code', 'sample_id', 11)})
SELECT sample_id, wb_code, CASE WHEN pos < round(size * 0.6e0) THEN 'train' ELSE 'test' END AS split FROM p""")
def stratified_split(spark, folder):
    return ft.stratified_split(meas(spark, folder).select("sample_id", "wb_code"), "wb_code", ["sample_id"], 0.6, seed=11)


_SITE = "w AS (SELECT site_id, wb_code, rbd, " + ", ".join(f"avg(value) FILTER (target = '{t}') AS {t}" for t in TARGETS) + " FROM me GROUP BY ALL)"
_Z = ", ".join(f"({t} - avg({t}) OVER ()) / stddev_pop({t}) OVER () AS {t}" for t in TARGETS)


@query("prep_features", f"""
WITH {_SITE}, z AS (SELECT site_id, wb_code, rbd, {_Z} FROM w), p AS ({_placed('z', 'wb_code', 'site_id', 2)})
SELECT site_id, wb_code, rbd, {_each('coalesce({t}, 0)')}, CASE WHEN pos < round(size * 0.5e0) THEN 'train' ELSE 'test' END AS split FROM p""")
def prep_features(spark, folder):
    return swiss.prep_features(swiss.merge_data(meas(spark, folder), sites(spark, folder)), 0.5, seed=2)


KEPT = [t for t in TARGETS if t != "SMALL"]
_ZW = ", ".join(f"({t} - avg({t}) OVER ()) / stddev_pop({t}) OVER () AS {t}" for t in KEPT)


#: The prepared matrix, as common table expressions that end in ``prepared``.
PREPARED_SQL = f"""w AS (SELECT site_id, wb_code, {", ".join(f"max(mean) FILTER (target = '{t}') AS {t}" for t in KEPT)} FROM asw GROUP BY ALL),
z AS (SELECT site_id, wb_code, {_ZW} FROM w), c AS (SELECT * FROM z WHERE {" AND ".join(f"{t} IS NOT NULL" for t in KEPT)}),
u AS ({_placed('c', 'wb_code', 'site_id', 4)}),
b AS (SELECT site_id, wb_code, {", ".join(KEPT)} FROM u WHERE pos < (SELECT min(n) FROM (SELECT count(*) AS n FROM c GROUP BY wb_code))),
p AS ({_placed('b', 'wb_code', 'site_id', 5)}),
prepared AS (SELECT site_id, wb_code, {", ".join(KEPT)}, CASE WHEN pos < round(size * 0.5e0) THEN 'train' ELSE 'test' END AS split FROM p)"""


@query("prep_water_body", f"WITH {PREPARED_SQL} SELECT site_id, wb_code, {', '.join(f'R({t}) AS {t}' for t in KEPT)}, split FROM prepared")
def prep_water_body(spark, folder):
    return europe.prep_water_body(aggregated(spark, folder, "site_id", "wb_code", "target"),
                                  aggregated(spark, folder, "wb_code", "target"), 30, 50, 6, seed=4)


def _approach(key: str, stats: dict[str, str], fill: bool, source: str) -> str:
    """Feature table, filled with 0 or reduced to complete rows, then scaled."""
    names = [f"{s}_{t}" for s in stats for t in TARGETS]
    cells = ", ".join(
        (f"coalesce({form}, 0)" if fill else form).format(f=f"FILTER (target = '{t}')") + f" AS {s}_{t}"
        for s, form in stats.items() for t in TARGETS)
    where = "" if fill else " WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names)
    scaled = ", ".join(f"R(({n} - avg({n}) OVER ()) / stddev_samp({n}) OVER ()) AS {n}" for n in names)
    return f"""WITH w AS (SELECT {key} AS obs_id, {cells} FROM {source} GROUP BY ALL), k AS (SELECT * FROM w{where})
SELECT obs_id, {scaled} FROM k"""


_SITE_ID = "wb_code || '-' || CAST(site_id AS VARCHAR)"
_SEASON_ID = "season || '-' || " + _SITE_ID
_MONTH_ID = "CAST(month AS VARCHAR) || '-' || " + _SITE_ID


@query("feature_approaches", _approach(_SITE_ID, {"avg": "avg(value) {f}", "sd": "stddev_samp(value) {f}"}, True, "me"))
def feature_approaches(spark, folder):
    return ft.feature_approaches(merged(spark, folder), "site", ("avg", "sd"), TARGETS)


@query("feature_approaches_semester", _approach(_SEASON_ID, {"avg": "avg(value) {f}", "sd": "stddev_samp(value) {f}"}, True, "me"))
def feature_approaches_semester(spark, folder):
    return ft.feature_approaches(merged(spark, folder), "semester", ("avg", "sd"), TARGETS)


@query("feature_approaches_month", _approach(_MONTH_ID, {
    "avg": "CASE WHEN count(*) {f} = count(value) {f} THEN avg(value) {f} END",
    "sd": "CASE WHEN count(*) {f} = count(value) {f} THEN stddev_samp(value) {f} END"}, True, "mp"))
def feature_approaches_month(spark, folder):
    df = derive_period(meas(spark, folder), "sampled_on")
    return ft.feature_approaches(df, "month", ("avg", "sd"), TARGETS, variance_filter=False)


@query("feature_approaches_four_stats", _approach(_SITE_ID, {
    "min": "min(value) {f}", "avg": "avg(value) {f}", "max": "max(value) {f}", "sd": "stddev_samp(value) {f}"}, False, "me"))
def feature_approaches_four_stats(spark, folder):
    return ft.feature_approaches(merged(spark, folder), "site", ("min", "avg", "max", "sd"), TARGETS, impute="drop",
                                 variance_filter=False)


_SEASON = """
r AS (SELECT site_id, target, CASE season WHEN 'winter' THEN 'W' ELSE 'S' END AS season, lat, lon, country, rbd, n, mean, sd, below_loq_sum, below_loq_pct
  FROM ase JOIN (SELECT DISTINCT site_id, lat, lon, country, rbd FROM sd WHERE lat IS NOT NULL) USING (site_id)),
c AS (SELECT country FROM (SELECT DISTINCT country, target, season FROM r) GROUP BY country
  HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT target, season FROM r))),
k AS (SELECT * FROM r WHERE country IN (SELECT country FROM c))"""


def _season_rows(spark, folder):
    known = priority_dedupe_sites(sites(spark, folder)).select("site_id", "lat", "lon", "country", "rbd")
    return seasons.season_table(aggregated(spark, folder, "site_id", "target", "season"), known)


@query("season_recap", f"""WITH {_SEASON}
SELECT target, country, season, count(DISTINCT site_id) AS n_sites, CAST(sum(n) AS BIGINT) AS n_measurements,
  min(n) AS min_measurements, max(n) AS max_measurements, R(quantile_cont(n, 0.5)) AS med_measurements FROM k GROUP BY ALL""")
def season_recap(spark, folder):
    return seasons.season_recap(_season_rows(spark, folder))


@query("season_matrix", f"""WITH {_SEASON}
SELECT site_id, season, R(lat) AS lat, R(lon) AS lon, country, rbd, """ + ", ".join(
    (f"R(CASE WHEN count(*) FILTER (target = '{t}') = 0 THEN 0 ELSE max({v}) FILTER (target = '{t}') END) AS \"{v}_{t}\"" if v in ("mean", "sd", "below_loq_pct")
     else f"CAST(coalesce(max({v}) FILTER (target = '{t}'), 0) AS BIGINT) AS \"{v}_{t}\"") for v in seasons.MEASURES for t in TARGETS)
    + " FROM k GROUP BY site_id, season, lat, lon, country, rbd")
def season_matrix(spark, folder):
    return seasons.season_matrix(_season_rows(spark, folder))
