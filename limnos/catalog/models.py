"""2.14 Distances, clustering, projection, classification and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.catalog import sql_text
from limnos.catalog.registry import TARGETS, merged, query
from limnos.catalog.statistics import KEPT, PREPARED_SQL, prep_water_body
from limnos.functions.nulls import col
from limnos.operators import evaluation as ev
from limnos.operators import models as ml
from limnos.operators import neighbours as nn
from limnos.operators.features import scale_sample
from limnos.operators.reshape import site_target_matrix
from limnos.plans import europe
from limnos.session import staged
from limnos.sources.driver_tables import table

EMBEDDING_SIZE = 64
EMBEDDING = [f"x{i}" for i in range(EMBEDDING_SIZE)]


def _matrix(spark, folder, condition: str = "true"):
    """Complete site rows in millions; columns are the targets."""
    wide = site_target_matrix(merged(spark, folder).where(condition), TARGETS, ["site_id", "wb_code"])
    return wide.dropna(subset=TARGETS).select("site_id", "wb_code", *[(col(t) / 1e6).alias(t) for t in TARGETS])


def _sql_matrix(name: str, condition: str = "true") -> str:
    cells = ", ".join(f"avg(value) FILTER (target = '{t}') / 1e6 AS {t}" for t in TARGETS)
    complete = " AND ".join(f"{t} IS NOT NULL" for t in TARGETS)
    return f"{name} AS (SELECT * FROM (SELECT site_id, wb_code, {cells} FROM me WHERE {condition} GROUP BY ALL) WHERE {complete})"


def _sql_distance(a: str, b: str) -> str:
    return "sqrt(" + " + ".join(f"({a}.{t} - {b}.{t}) ** 2" for t in TARGETS) + ")"


def _embeddings(spark, folder):
    return ml.expand_array(table(spark, folder, "embeddings"), "embedding", EMBEDDING_SIZE)


EARLY, LATE = "year <= 1997", "year >= 1998"


@query("pairwise_distance", f"""
WITH {_sql_matrix('w')}, z AS (SELECT site_id, {", ".join(f"({t} - avg({t}) OVER ()) / stddev_samp({t}) OVER () AS {t}" for t in TARGETS)} FROM w),
d AS (SELECT a.site_id AS id_a, b.site_id AS id_b, {_sql_distance('a', 'b')} AS distance FROM z a JOIN z b ON a.site_id <> b.site_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) AS rank FROM d)
SELECT id_a, id_b, R(distance) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def pairwise_distance(spark, folder):
    return nn.nearest_distances(scale_sample(_matrix(spark, folder), TARGETS), "site_id", TARGETS, 5)


_KNN = f"""{_sql_matrix('a', EARLY)}, {_sql_matrix('q', LATE)},
d AS (SELECT q.site_id, q.wb_code AS actual, a.wb_code AS vote, row_number() OVER (PARTITION BY q.site_id
  ORDER BY {_sql_distance('a', 'q')}, a.site_id) AS r FROM q, a),
v AS (SELECT site_id, actual, vote, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL),
pred AS (SELECT site_id, actual, vote AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, vote) = 1)"""


@query("classify_knn", f"WITH {_KNN} SELECT site_id, actual, predicted FROM pred")
def classify_knn(spark, folder):
    return nn.classify_knn(_matrix(spark, folder, EARLY), _matrix(spark, folder, LATE), "site_id", "wb_code", TARGETS, 5)


@query("classify_knn_embeddings", """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b_id) AS r FROM (
  SELECT a.vec_id, a.label AS actual, b.vec_id AS b_id, b.label AS vote, sqrt(list_sum([(x[1] - x[2]) ** 2 FOR x IN
    list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))])) AS dist
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) a),
v AS (SELECT vec_id, actual, vote, count(*) AS n FROM e WHERE r <= 5 GROUP BY ALL)
SELECT vec_id, actual, vote AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, vote) = 1""")
def classify_knn_embeddings(spark, folder):
    """Leave-one-out vote over the raw vectors."""
    rows = table(spark, folder, "embeddings").select(
        "vec_id", "label", col("embedding").cast("array<double>").alias("features"))
    train = rows.select(col("vec_id").alias("train_id"), col("label").alias("vote"), "features")
    found = nn.nearest_neighbours(rows, train, 6, "vec_id", "train_id", carry=["vote"])
    others = found.where("vec_id <> train_id")
    votes = nn.keep_nearest(others, "vec_id", "train_id", 5)
    return nn.majority(votes, "vec_id", "vote").join(
        rows.select("vec_id", col("label").alias("actual")), "vec_id").select("vec_id", "actual", "predicted")


@query("knn_tune", f"""
WITH {_sql_matrix('w')}, p AS (SELECT *, (row_number() OVER (PARTITION BY wb_code ORDER BY {sql_text.draw(0, 'site_id')}, site_id) - 1) % 10 AS fold FROM w),
d AS (SELECT a.site_id, a.wb_code AS actual, a.fold, b.wb_code AS vote, row_number() OVER (PARTITION BY a.site_id
  ORDER BY {_sql_distance('a', 'b')}, b.site_id) AS r FROM p a JOIN p b ON a.fold <> b.fold),
ks AS (SELECT DISTINCT r AS k FROM d WHERE r <= (SELECT 2 * floor(sqrt(count(*))) FROM w)),
v AS (SELECT k, site_id, actual, fold, vote, count(*) AS n FROM d JOIN ks ON r <= k GROUP BY ALL),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY k, site_id ORDER BY n DESC, vote) = 1),
s AS (SELECT k, fold, avg(CASE WHEN vote = actual THEN 1.0e0 ELSE 0.0e0 END) AS a FROM b GROUP BY ALL)
SELECT CAST(k AS INTEGER) AS k, R(avg(a)) AS accuracy, R(stddev_samp(a)) AS accuracy_sd, count(*) AS folds FROM s GROUP BY k""")
def knn_tune(spark, folder):
    df = _matrix(spark, folder)
    largest = 2 * int(df.count() ** 0.5)
    return nn.knn_tune(df, "site_id", "wb_code", TARGETS, range(1, largest + 1))


@query("kmeans")
def kmeans(spark, folder):
    return ml.kmeans(_embeddings(spark, folder), EMBEDDING, 10).select("vec_id", "label", "cluster")


@query("kmeans_sites")
def kmeans_sites(spark, folder):
    return ml.kmeans(_matrix(spark, folder), TARGETS, 2).select("site_id", "wb_code", "cluster")


@query("kmeans_sweep")
def kmeans_sweep(spark, folder):
    return ml.kmeans_sweep(_embeddings(spark, folder), EMBEDDING)


@query("gmm_sweep")
def gmm_sweep(spark, folder):
    """Mixtures of 1 to 12 components over the whole site matrix."""
    return ml.gmm_sweep(_matrix(spark, folder), TARGETS)


def _pairs(form: str) -> str:
    return ", ".join(form.format(i=i, j=j, a=TARGETS[i], b=TARGETS[j]) for i in range(len(TARGETS)) for j in range(i, len(TARGETS)))


def _eliminated_sql(source: str, last: str) -> str:
    """Pivots p0, p1, ... of a symmetric matrix c_i_j: their product is the determinant."""
    steps, d = [], len(TARGETS)
    for k in range(d):
        left = ", ".join(f"c_{i}_{j} - c_{k}_{i} * c_{k}_{j} / c_{k}_{k} AS c_{i}_{j}" for i in range(k + 1, d) for j in range(i, d))
        done = "".join(f", p{i}" for i in range(k))
        steps.append(f"g{k + 1} AS (SELECT n, c_{k}_{k} AS p{k}{done}{', ' + left if left else ''} FROM {source if k == 0 else f'g{k}'})")
    return ", ".join(steps) + f", {last} AS (SELECT * FROM g{d})"


@query("gmm_single", f"""
WITH {_sql_matrix('w')}, s AS (SELECT CAST(count(*) AS DOUBLE) AS n, {_pairs("covar_pop({a}, {b}) AS c_{i}_{j}")} FROM w), {_eliminated_sql('s', 'p')},
l AS (SELECT n, -n / 2 * ({len(TARGETS)} * ln(2 * pi()) + {" + ".join(f"ln(p{i})" for i in range(len(TARGETS)))} + {len(TARGETS)}) AS ll, {len(TARGETS) * (len(TARGETS) + 3) // 2} AS free FROM p)
SELECT CAST(1 AS INTEGER) AS k, R(ll) AS log_likelihood, R(2 * free - 2 * ll) AS aic, R(free * ln(n) - 2 * ll) AS bic, R(CAST(NULL AS DOUBLE)) AS silhouette, true AS best FROM l""", digits=3)
def gmm_single(spark, folder):
    """The mixture of one component, which has a closed form."""
    return ml.gmm_sweep(_matrix(spark, folder), TARGETS, [1])


def _principal_sql(covariance: str, components: int, squarings: int = 14) -> str:
    """Components of a matrix ``covariance`` (i, j, v) by repeated squaring and deflation, as ``pc`` (c, i, w, value)."""
    out = [f"d1 AS MATERIALIZED (SELECT * FROM {covariance})"]
    for c in range(1, components + 1):
        out.append(f"q{c}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM d{c} WHERE i = j) AS v FROM d{c})")
        for s in range(squarings):
            out.append(f"r{c}_{s} AS MATERIALIZED (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM q{c}_{s} a JOIN q{c}_{s} b ON a.j = b.i GROUP BY a.i, b.j), "
                       f"q{c}_{s + 1} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM r{c}_{s} WHERE i = j) AS v FROM r{c}_{s})")
        # A column of the power is the component, up to its length and sign.
        out.append(f"u{c} AS MATERIALIZED (SELECT i, v FROM q{c}_{squarings} WHERE j = (SELECT i FROM q{c}_{squarings} WHERE i = j ORDER BY v DESC LIMIT 1)), "
                   f"v{c} AS MATERIALIZED (SELECT i, v / sqrt((SELECT sum(v * v) FROM u{c})) * sign((SELECT v FROM u{c} ORDER BY abs(v) DESC LIMIT 1)) AS w FROM u{c}), "
                   f"l{c} AS MATERIALIZED (SELECT sum(x.w * d.v * y.w) AS value FROM d{c} d JOIN v{c} x ON x.i = d.i JOIN v{c} y ON y.i = d.j), "
                   f"d{c + 1} AS MATERIALIZED (SELECT d.i, d.j, d.v - (SELECT value FROM l{c}) * x.w * y.w AS v FROM d{c} d JOIN v{c} x ON x.i = d.i JOIN v{c} y ON y.i = d.j)")
    union = " UNION ALL ".join(f"SELECT {c} AS c, i, w, (SELECT value FROM l{c}) AS value FROM v{c}" for c in range(1, components + 1))
    return ", ".join(out) + f", pc AS ({union})"


@query("pca", f"""
WITH x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, {EMBEDDING_SIZE + 1}) t(i)),
z AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM x),
cv AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM z a JOIN z b USING (vec_id) GROUP BY a.i, b.i), {_principal_sql("cv", 5)}
SELECT CAST(c AS INTEGER) AS component, R(max(value) / (SELECT sum(v) FROM cv WHERE i = j)) AS variance_ratio FROM pc GROUP BY c""")
def pca(spark, folder):
    return ml.pca(_embeddings(spark, folder), EMBEDDING, 5)[1]


_SCALED = f"""{_sql_matrix('w')}, x AS (SELECT site_id, wb_code, unnest({TARGETS!r}) AS f, unnest(range(1, {len(TARGETS) + 1})) AS i, unnest([{', '.join(TARGETS)}]) AS x FROM w),
z AS MATERIALIZED (SELECT site_id, wb_code, f, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_samp(x) OVER (PARTITION BY i) AS x FROM x),
cv AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM z a JOIN z b USING (site_id) GROUP BY a.i, b.i), {_principal_sql("cv", 3)}"""


@query("pca_scores", f"""
WITH {_SCALED}
SELECT site_id, wb_code, {", ".join(f"R(sum(x * w) FILTER (c = {c})) AS PC{c}" for c in (1, 2, 3))} FROM z JOIN pc USING (i) GROUP BY site_id, wb_code""")
def pca_scores(spark, folder):
    return ml.pca(_matrix(spark, folder), TARGETS, 3, scale=True)[0]


@query("pca_loadings", f"""
WITH {_SCALED}
SELECT f AS feature, {", ".join(f"R(max(w) FILTER (c = {c})) AS PC{c}" for c in (1, 2, 3))} FROM (SELECT DISTINCT f, i FROM z) JOIN pc USING (i) GROUP BY f""")
def pca_loadings(spark, folder):
    return ml.pca(_matrix(spark, folder), TARGETS, 3, scale=True)[2]


@query("cluster_projection")
def cluster_projection(spark, folder):
    return ml.cluster_projection(_matrix(spark, folder), TARGETS, ["site_id", "wb_code"], 4)


def _split(spark, folder):
    return _matrix(spark, folder, EARLY), _matrix(spark, folder, LATE)


@query("classify_linear_svc")
def classify_linear_svc(spark, folder):
    return ml.classify_linear_svc(*_split(spark, folder), ["site_id"], "wb_code", TARGETS)


@query("classify_random_forest")
def classify_random_forest(spark, folder):
    return ml.classify_random_forest(*_split(spark, folder), ["site_id"], "wb_code", TARGETS)


@query("classify_svc_rbf")
def classify_svc_rbf(spark, folder):
    return ml.classify_svc_rbf(*_split(spark, folder), ["site_id"], "wb_code", TARGETS)


_GIVEN = """pred AS (SELECT o_orderstatus AS actual,
  CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 320000 THEN 'O' ELSE 'P' END AS predicted FROM orders)"""


def _given(spark, folder):
    price = col("o_totalprice")
    return table(spark, folder, "orders").select(
        col("o_orderstatus").alias("actual"),
        F.when(price < 150000, "F").when(price < 320000, "O").otherwise("P").alias("predicted"))


_CLASSES = """l AS (SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(g) AS BIGINT) AS given, CAST(sum(h) AS BIGINT) AS hits FROM (
  SELECT actual AS label, 1 AS s, 0 AS g, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS h FROM pred
  UNION ALL SELECT predicted, 0, 1, 0 FROM pred) GROUP BY label)"""


@query("confusion_matrix", f"""
WITH {_GIVEN} SELECT actual, count(*) FILTER (predicted = 'F') AS F, count(*) FILTER (predicted = 'O') AS O,
  count(*) FILTER (predicted = 'P') AS P FROM pred GROUP BY actual""")
def confusion_matrix(spark, folder):
    return ev.confusion_matrix(_given(spark, folder), ["F", "O", "P"])


@query("overall_statistics", f"""
WITH {_GIVEN}, {_CLASSES}, t AS (SELECT sum(support) AS n, sum(hits) / CAST(sum(support) AS DOUBLE) AS po,
  sum(CAST(support AS DOUBLE) * given) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS pe FROM l)
SELECT CAST(n AS BIGINT) AS n, R(po) AS accuracy, R((po - pe) / (1 - pe)) AS kappa FROM t""")
def overall_statistics(spark, folder):
    return ev.overall_statistics(_given(spark, folder))


@query("class_statistics", f"""
WITH {_GIVEN}, {_CLASSES}, n AS (SELECT count(*) AS n FROM pred)
SELECT label, support, given, hits, R(hits / CAST(support AS DOUBLE)) AS sensitivity,
  R((n - support - (given - hits)) / CAST(n - support AS DOUBLE)) AS specificity FROM l, n""")
def class_statistics(spark, folder):
    return ev.class_statistics(_given(spark, folder))


_REPORT = f"""{_CLASSES}, f AS (SELECT label, support, hits, coalesce(hits / CAST(nullif(given, 0) AS DOUBLE), 0) AS p,
  coalesce(hits / CAST(nullif(support, 0) AS DOUBLE), 0) AS r, 2.0e0 * hits / (given + support) AS f1 FROM l)
SELECT label, R(p) AS precision, R(r) AS recall, R(f1) AS f1, support FROM f
UNION ALL SELECT 'accuracy', R(sum(hits) / CAST(sum(support) AS DOUBLE)), R(sum(hits) / CAST(sum(support) AS DOUBLE)),
  R(sum(hits) / CAST(sum(support) AS DOUBLE)), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', R(avg(p)), R(avg(r)), R(avg(f1)), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', R(sum(p * support) / sum(support)), R(sum(r * support) / sum(support)),
  R(sum(f1 * support) / sum(support)), CAST(sum(support) AS BIGINT) FROM f"""


@query("classification_report", f"WITH {_GIVEN}, {_REPORT}")
def classification_report(spark, folder):
    return ev.classification_report(_given(spark, folder))


@query("classify_knn_report", f"WITH {_KNN}, {_REPORT}")
def classify_knn_report(spark, folder):
    pred = nn.classify_knn(*_split(spark, folder), "site_id", "wb_code", TARGETS, 5)
    return ev.classification_report(pred)


_PLAN = f"""{PREPARED_SQL}, ts AS (SELECT {", ".join(f"avg({t}) AS m_{t}, stddev_pop({t}) AS s_{t}" for t in KEPT)} FROM prepared WHERE split = 'train'),
x AS (SELECT site_id, wb_code, split, {", ".join(f"({t} - m_{t}) / s_{t} AS {t}" for t in KEPT)} FROM prepared, ts),
d AS (SELECT q.site_id, q.wb_code AS actual, a.wb_code AS vote, row_number() OVER (PARTITION BY q.site_id
  ORDER BY sqrt({" + ".join(f"(a.{t} - q.{t}) ** 2" for t in KEPT)}), a.site_id) AS r FROM x q, x a WHERE q.split = 'test' AND a.split = 'train'),
v AS (SELECT site_id, actual, vote, count(*) AS n FROM d WHERE r <= 5 GROUP BY ALL),
pred AS (SELECT site_id, actual, vote AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, vote) = 1)"""


@query("water_body_neighbours", f"WITH {_PLAN} SELECT site_id, actual, predicted FROM pred")
def water_body_neighbours(spark, folder):
    """Test sites of the prepared matrix, classified by a plan fitted to its training sites."""
    prepared = staged(prep_water_body(spark, folder))
    return europe.fit_plan(prepared, KEPT, "k_neighbours").predict(prepared.where("split = 'test'"))


@query("water_body_report", f"WITH {_PLAN}, {_REPORT}")
def water_body_report(spark, folder):
    return europe.classify_water_bodies(prep_water_body(spark, folder), KEPT, "k_neighbours")


@query("water_body_report_forest")
def water_body_report_forest(spark, folder):
    return europe.classify_water_bodies(prep_water_body(spark, folder), KEPT, "random_forest")


@query("water_body_clusters")
def water_body_clusters(spark, folder):
    return europe.cluster_water_bodies(prep_water_body(spark, folder), KEPT)


@query("water_body_variance", f"""
WITH {PREPARED_SQL}, lx AS (SELECT site_id, unnest(range(1, {len(KEPT) + 1})) AS i, unnest([{", ".join(KEPT)}]) AS x FROM prepared),
lz AS MATERIALIZED (SELECT site_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM lx),
cv AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM lz a JOIN lz b USING (site_id) GROUP BY a.i, b.i), {_principal_sql("cv", 2)}
SELECT CAST(c AS INTEGER) AS component, R(max(value) / (SELECT sum(v) FROM cv WHERE i = j)) AS variance_ratio FROM pc GROUP BY c""")
def water_body_variance(spark, folder):
    """Shares of variance of the first components of the prepared matrix."""
    return europe.project_water_bodies(prep_water_body(spark, folder), KEPT)[1]
