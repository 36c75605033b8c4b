"""Scoring and training queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import linear_fits as lf
from locusframe.operators import network as n
from locusframe.operators import subject_training as st
from locusframe.operators import training as t
from locusframe.operators.topology import topology_edges
from locusframe.plans.registry import query, r6, sql6
from locusframe.plans.views import Views


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def small_network(v: Views, kinds: tuple[str, ...] = ("tanh", "tanh", "sigmoid")) -> n.Network:
    return n.Network(v.small_weights, v.small_bias, list(kinds))


Z0 = """
    z0 AS (SELECT subject_id, dst AS node, sum(dosage * w) + max(b) AS z
           FROM genotype JOIN small_weights s ON s.layer = 0 AND src = variant_id JOIN small_bias b ON b.layer = 0 AND b.node = dst
           GROUP BY subject_id, dst)"""
SCORES = Z0 + """,
    z1 AS (SELECT subject_id, dst AS node, sum(tanh(z) * w) + max(b) AS z FROM z0 JOIN small_weights s ON s.layer = 1 AND src = z0.node
           JOIN small_bias b ON b.layer = 1 AND b.node = dst GROUP BY subject_id, dst),
    z2 AS (SELECT subject_id, sum(tanh(z) * w) + max(b) AS z FROM z1 JOIN small_weights s ON s.layer = 2 AND src = z1.node
           JOIN small_bias b ON b.layer = 2 AND b.node = dst GROUP BY subject_id, dst),
    scores AS (SELECT subject_id, 1 / (1 + exp(-z)) AS p FROM z2)"""


#: Values of every customer in every node of the sparse network, unlisted cells being 0.
SPARSE_Z0 = """
    cells AS (SELECT subject_id, dst AS node, sum(dosage * w) AS s FROM genotype_sparse JOIN weights ON layer = 0 AND src = variant_id GROUP BY subject_id, dst),
    s0 AS (SELECT c_custkey AS subject_id, bias.node, b + coalesce(s, 0) AS z FROM customer JOIN bias ON layer = 0
           LEFT JOIN cells ON cells.subject_id = c_custkey AND cells.node = bias.node)"""


@query("genotype_sparse weights bias", f"WITH {SPARSE_Z0} SELECT subject_id, node, {sql6('z')} AS value FROM s0")
def layer_forward(v: Views) -> DataFrame:
    net = n.Network(v.weights, v.bias, ["tanh"] * 3)
    customers = v.table("customer").select(F.col("c_custkey").alias("subject_id"))
    return rounded(n.layer_forward(n.as_nodes(v.genotype_sparse), *net.layer(0), customers), "value")


@query("genotype_sparse weights bias", f"""WITH {SPARSE_Z0},
    s1 AS (SELECT subject_id, dst AS node, sum(tanh(z) * w) + max(b) AS z FROM s0 JOIN weights s ON s.layer = 1 AND src = s0.node
           JOIN bias b ON b.layer = 1 AND b.node = dst GROUP BY subject_id, dst),
    s2 AS (SELECT subject_id, sum(tanh(z) * w) + max(b) AS z FROM s1 JOIN weights s ON s.layer = 2 AND src = s1.node
           JOIN bias b ON b.layer = 2 AND b.node = dst GROUP BY subject_id, dst)
    SELECT subject_id, {sql6('1 / (1 + exp(-z))')} AS p FROM s2""")
def predict_sparse(v: Views) -> DataFrame:
    """Scores of all customers, also of those without a listed cell."""
    net = n.Network(v.weights, v.bias, ["tanh", "tanh", "sigmoid"])
    customers = v.table("customer").select(F.col("c_custkey").alias("subject_id"))
    return rounded(n.predict(net, n.as_nodes(v.genotype_sparse), customers), "p")


@query("genotype small_weights", f"""
    SELECT subject_id, CAST(dst AS BIGINT) AS node, f AS filter, {sql6('sum(dosage * (w + f * 0.25e0))')} AS value
    FROM genotype JOIN small_weights ON layer = 0 AND src = variant_id, (SELECT unnest([0, 1, 2]) AS f) GROUP BY subject_id, dst, f""")
def layer_forward_filters(v: Views) -> DataFrame:
    return rounded(n.layer_forward(n.as_nodes(v.genotype), filter_weights(v)), "value")


def filter_weights(v: Views) -> DataFrame:
    w = v.small_weights.filter("layer = 0").select("src", "dst", "w", F.explode(F.array(*[F.lit(f) for f in range(3)])).alias("filter"))
    return w.withColumn("w", F.col("w") + F.col("filter") * 0.25)


@query("genotype small_weights", f"""
    WITH z AS (SELECT subject_id, dst AS node, f, tanh(sum(dosage * (w + f * 0.25e0))) AS a
               FROM genotype JOIN small_weights ON layer = 0 AND src = variant_id, (SELECT unnest([0, 1, 2]) AS f) GROUP BY subject_id, dst, f)
    SELECT subject_id, CAST(node AS BIGINT) AS node, {sql6('sum(a * (f - 1 + node / 10.0e0))')} AS value FROM z GROUP BY subject_id, node""")
def multi_filter_network(v: Views) -> DataFrame:
    """A gene layer with three filters, then one weight per node and filter."""
    w = filter_weights(v)
    acts = n.apply_activation(n.layer_forward(n.as_nodes(v.genotype), w), "tanh")
    per_node = w.select(F.col("dst").alias("node"), "filter").distinct()
    per_node = per_node.withColumn("w", F.col("filter") - 1 + F.col("node") / 10.0)
    return rounded(n.node_layer(acts, per_node), "value")


@query("prediction", f"""
    SELECT subject_id, {sql6('tanh(p - 0.5e0)')} AS tanh, {sql6('greatest(p - 0.5e0, 0)')} AS relu, {sql6('1 / (1 + exp(-(p - 0.5e0)))')} AS sigmoid,
           {sql6('p - 0.5e0')} AS linear FROM prediction""")
def activations(v: Views) -> DataFrame:
    z = F.col("p") - 0.5
    return v.prediction.select("subject_id", *[r6(n.activate(z, k)).alias(k) for k in ("tanh", "relu", "sigmoid", "linear")])


@query("genotype_sparse", f"""
    WITH m AS (SELECT variant_id, avg(dosage) AS m, var_pop(dosage) AS s FROM genotype_sparse GROUP BY variant_id)
    SELECT subject_id, variant_id AS node, {sql6('(dosage - m) / sqrt(s + 1e-6)')} AS value FROM genotype_sparse JOIN m USING (variant_id)""")
def normalise_nodes(v: Views) -> DataFrame:
    x = n.as_nodes(v.genotype_sparse)
    return rounded(n.normalise(x, n.node_moments(x)), "value").select("subject_id", "node", "value")


@query("genotype_sparse", f"""
    WITH m AS (SELECT variant_id AS node, avg(dosage) AS m, var_pop(dosage) AS s FROM genotype_sparse GROUP BY variant_id)
    SELECT node, round(0.99e0 * (0.01e0 * m) + 0.01e0 * m, 12) AS mean, round(0.99e0 * (0.99e0 + 0.01e0 * s) + 0.01e0 * s, 12) AS variance FROM m""")
def running_moments(v: Views) -> DataFrame:
    """Two updates of the weighted moments by the same batch."""
    now = n.node_moments(n.as_nodes(v.genotype_sparse))
    once = n.update_moments(now.limit(0), now)
    # Twelve places: the products of short fractions end late.
    twice = n.update_moments(once, now)
    return twice.select("node", F.round("mean", 12).alias("mean"), F.round("variance", 12).alias("variance"))


@query("genotype_sparse weights", f"""
    WITH g AS (SELECT dst, avg(dosage) AS m, var_pop(dosage) AS s FROM genotype_sparse JOIN weights ON layer = 0 AND src = variant_id GROUP BY dst),
    i AS (SELECT src, sum(m) AS m, sum(s) AS s FROM weights JOIN g USING (dst) WHERE layer = 0 GROUP BY src)
    SELECT subject_id, variant_id AS node, {sql6('(dosage - m) / sqrt(s + 1e-6)')} AS value FROM genotype_sparse JOIN i ON src = variant_id""")
def normalise_connected(v: Views) -> DataFrame:
    edges = v.w0.select("src", "dst")
    return rounded(n.normalise_connected(n.as_nodes(v.genotype_sparse), edges), "value").select("subject_id", "node", "value")


@query("genotype_sparse", f"SELECT subject_id, {sql6('sum(dosage * (variant_id % 11 - 5)) + 0.5e0')} AS score FROM genotype_sparse GROUP BY subject_id")
def dense_output(v: Views) -> DataFrame:
    w = v.genotype_sparse.select(F.col("variant_id").alias("node")).distinct().withColumn("w", (F.col("node") % 11 - 5).cast("double"))
    return rounded(n.dense_output(n.as_nodes(v.genotype_sparse), w, 0.5), "score")


@query("genotype small_weights small_bias subject", f"""WITH {SCORES}
    SELECT subject_id, {sql6('1 / (1 + exp(-(0.1e0 + 1.5e0 * (1 / (1 + exp(-p))) - 0.2e0 * cov_1 + 0.05e0 * (cov_2 - 5) / sqrt(10 + 1e-6))))')} AS score
    FROM (SELECT subject_id, p, cov_1 / sqrt(1 + 1e-6) AS cov_1, cov_2 FROM scores JOIN subject USING (subject_id))""".replace(
    "1.5e0 * (1 / (1 + exp(-p)))", "1.5e0 * (1 / (1 + exp(-p))) / sqrt(1 + 1e-6)"))
def covariate_head(v: Views) -> DataFrame:
    scores = n.predict(small_network(v), n.as_nodes(v.genotype)).withColumnRenamed("p", "score")
    covs = v.subject.select("subject_id", "cov_1", "cov_2")
    weights = {"score": 1.5, "cov_1": -0.2, "cov_2": 0.05}
    moments = {"score": (0.0, 1.0), "cov_1": (0.0, 1.0), "cov_2": (5.0, 10.0)}
    return rounded(n.covariate_head(scores, covs, weights, 0.1, "sigmoid", moments), "score")


@query("genotype", f"SELECT subject_id, CAST(variant_id AS BIGINT) AS node, {sql6('variant_id / 64.0e0 + dosage')} AS value FROM genotype")
def one_hot_layer(v: Views) -> DataFrame:
    """Class weights start as w, w + 1, w + 2."""
    w = v.genotype.select("variant_id").distinct().withColumn("w", F.col("variant_id") / 64.0)
    return rounded(n.one_hot_layer(v.genotype, n.linear_one_hot(w)), "value")


@query("weights", f"SELECT {sql6('sum(abs(w)) * 0.01e0')} AS penalty FROM weights")
def l1_penalty(v: Views) -> DataFrame:
    return rounded(n.l1_penalty(v.weights, 0.01), "penalty")


@query("genotype small_weights small_bias", f"WITH {SCORES} SELECT subject_id, {sql6('p')} AS p FROM scores")
def predict(v: Views) -> DataFrame:
    return rounded(n.predict(small_network(v), n.as_nodes(v.genotype)), "p")


@query("genotype small_weights small_bias", f"""WITH {Z0},
    s AS (SELECT node, stddev_pop(tanh(z)) AS s FROM z0 GROUP BY node),
    i AS (SELECT node, abs(w * s) AS importance FROM s JOIN small_weights ON layer = 1 AND src = node)
    SELECT node, {sql6('importance')} AS importance, {sql6('importance / (SELECT max(importance) FROM i)')} AS relative FROM i""")
def activation_importance(v: Views) -> DataFrame:
    net = small_network(v)
    acts = n.apply_activation(n.layer_forward(n.as_nodes(v.genotype), *net.layer(0)), "tanh")
    w = v.small_weights.filter("layer = 1").select(F.col("src").alias("node"), "w")
    return rounded(n.activation_importance(acts, w), "importance", "relative").select(F.col("node").cast("int").alias("node"), "importance", "relative")


# ---------------------------------------------------------------- training


def cohort_sets(v: Views, label: str = "label_bin") -> tuple[DataFrame, DataFrame]:
    rows = v.subject.select("subject_id", F.col(label).cast("double").alias("label"), "cov_1", "cov_2", "set_id")
    return rows.filter("set_id = 1").drop("set_id"), rows.filter("set_id = 2").drop("set_id")


def history(v: Views, fit: t.Fit) -> DataFrame:
    rows = [(h["epoch"], float(h["loss"]), float(h["val_loss"]), float(h["rate"])) for h in fit.history]
    return v.spark.createDataFrame(rows, "epoch int, loss double, val_loss double, rate double")


#: Fits stop once PATIENCE epochs have not lowered the validation loss by MIN_DELTA.
PATIENCE, MIN_DELTA = 3, 0.005


@query()
def fit_topology_network(v: Views) -> DataFrame:
    """Loss per epoch of a gene and pathway network with covariates, to its stopping rule."""
    train, validation = cohort_sets(v)
    params = t.Params(learning_rate=0.05, patience=PATIENCE, min_delta=MIN_DELTA, l1=0.001, l1_activity=0.0)
    fit = st.fit_by_subject(v.genotype, train, validation, topology_edges(v.small_topology), params, covariates=["cov_1", "cov_2"])
    return history(v, fit)


@query()
def fit_gene_network_l1(v: Views) -> DataFrame:
    """Fitted weights of one gene layer, to its stopping rule."""
    train, validation = cohort_sets(v)
    params = t.Params(learning_rate=0.05, patience=PATIENCE, min_delta=MIN_DELTA, normalise=False)
    return st.fit_by_subject(v.genotype, train, validation, topology_edges(v.small_topology).filter("layer = 0"), params).network.edges


LASSO_L1 = 0.05


@query("genotype subject", f"""
    WITH RECURSIVE d AS (
        SELECT subject_id, CAST(variant_id AS BIGINT) AS j, CAST(dosage AS DOUBLE) AS x FROM genotype JOIN subject USING (subject_id) WHERE set_id = 1
        UNION ALL SELECT subject_id, 1000000000 + c, CASE c WHEN 1 THEN cov_1 ELSE cov_2 END FROM subject, (SELECT unnest([1, 2]) AS c) WHERE set_id = 1),
    moments AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM d GROUP BY j),
    z AS (SELECT subject_id, j, (x - m) / s AS x FROM d JOIN moments USING (j)),
    y AS (SELECT subject_id, label_reg - avg(label_reg) OVER () AS y FROM subject WHERE set_id = 1),
    products AS (SELECT a.j, b.j AS k, avg(a.x * b.x) AS v FROM z a JOIN z b USING (subject_id) GROUP BY a.j, b.j),
    lines AS (SELECT j, list(v ORDER BY k) AS line FROM products GROUP BY j),
    targets AS (SELECT j, avg(x * y) AS c FROM z JOIN y USING (subject_id) GROUP BY j),
    model AS MATERIALIZED (
        SELECT list(j ORDER BY j) AS js, list(line ORDER BY j) AS h, list(c ORDER BY j) AS c,
               list(CASE WHEN j > 1000000000 THEN 0.0e0 ELSE {LASSO_L1}e0 END ORDER BY j) AS l1
        FROM lines JOIN targets USING (j)),
    steps AS (
        SELECT 0 AS n, list_transform(js, lambda j: 0.0e0) AS w FROM model
        UNION ALL
        SELECT n + 1, list_transform(list_transform(range(1, len(js) + 1), lambda k: [w[k] + 0.25e0 * (c[k] - list_dot_product(h[k], w)), 0.25e0 * l1[k]]),
                                     lambda u: sign(u[1]) * greatest(abs(u[1]) - u[2], 0))
        FROM steps, model WHERE n < 1500)
    SELECT * FROM (SELECT unnest(js) AS src, unnest(list_transform(w, lambda v: {sql6('v')})) AS w FROM steps, model WHERE n = 1500) WHERE src < 1000000000""")
def fit_lasso(v: Views) -> DataFrame:
    """Linear L1 model of all variants, with free covariates, at its optimum; the SQL takes 1 500 proximal steps."""
    train, _ = cohort_sets(v, "label_reg")
    fit = lf.fit_lasso(v.genotype, train, LASSO_L1, ["cov_1", "cov_2"], regression=True)
    return rounded(fit.where("src IS NOT NULL").select("src", "w"), "w")


@query("genotype subject", f"""
    WITH RECURSIVE d AS (
        SELECT subject_id, CAST(variant_id AS BIGINT) AS j, CAST(dosage AS DOUBLE) AS x, label_bin FROM genotype JOIN subject USING (subject_id) WHERE set_id = 1),
    moments AS (SELECT j, avg(x) AS m, stddev_pop(x) AS s FROM d GROUP BY j),
    z AS (SELECT subject_id, j, (x - m) / s AS x, label_bin FROM d JOIN moments USING (j)
          UNION ALL SELECT DISTINCT subject_id, 1000000000, 1, label_bin FROM d),
    by_subject AS (SELECT subject_id, list(x ORDER BY j) AS line, any_value(label_bin) AS y FROM z GROUP BY subject_id),
    by_input AS (SELECT j, list(x ORDER BY subject_id) AS line FROM z GROUP BY j),
    model AS MATERIALIZED (
        SELECT (SELECT list(line ORDER BY subject_id) FROM by_subject) AS x, (SELECT list(CAST(y AS DOUBLE) ORDER BY subject_id) FROM by_subject) AS y,
               (SELECT list(line ORDER BY j) FROM by_input) AS t, (SELECT list(j ORDER BY j) FROM by_input) AS js),
    steps AS (
        SELECT 0 AS n, list_transform(js, lambda j: 0.0e0) AS w FROM model
        UNION ALL
        SELECT n + 1, list_transform(range(1, len(js) + 1), lambda k: w[k] - 1.5e0 / len(x) * list_dot_product(t[k], r))
        FROM (SELECT n, w, x, t, js, list_transform(range(1, len(x) + 1), lambda i: 1 / (1 + exp(-list_dot_product(x[i], w))) - y[i]) AS r FROM steps, model WHERE n < 1500)),
    fitted AS (SELECT unnest(js) AS j, unnest(w) AS w FROM steps, model WHERE n = 1500)
    SELECT j AS variant_id, {sql6('w / s')} AS coefficient FROM fitted JOIN moments USING (j)""")
def fit_logistic(v: Views) -> DataFrame:
    """Coefficients of the logistic comparator at its optimum, ranked; the SQL takes 1 500 gradient steps."""
    train, _ = cohort_sets(v)
    return rounded(lf.fit_logistic(v.genotype, train), "coefficient")
