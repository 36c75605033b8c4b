"""Interpretation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import interpret as i
from locusframe.operators import network as n
from locusframe.operators.cohort import rank_slice, top_hits
from locusframe.plans.networks import Z0, small_network
from locusframe.plans.registry import query, r9, sql9
from locusframe.plans.views import Views



def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r9(c).alias(c) if c in columns else F.col(c) for c in df.columns])


PATHS = """
    cw AS (SELECT t.*, w0.w AS weights_0, w1.w AS weights_1, w2.w AS weights_2, w0.w * w1.w * w2.w AS raw FROM topology t
           JOIN weights w0 ON w0.layer = 0 AND w0.src = layer0_node AND w0.dst = layer1_node
           JOIN weights w1 ON w1.layer = 1 AND w1.src = layer1_node AND w1.dst = layer2_node
           JOIN weights w2 ON w2.layer = 2 AND w2.src = layer2_node)"""
WITH_CHR = PATHS.replace("SELECT t.*", "SELECT layer0_node % 22 + 1 AS chr, t.*")


def paths(v: Views) -> DataFrame:
    return i.connection_weights(v.topology, v.weights)


def paths_with_chr(v: Views) -> DataFrame:
    return i.connection_weights(v.topology.withColumn("chr", F.col("layer0_node") % 22 + 1), v.weights)


@query("topology weights", f"""WITH {PATHS}
    SELECT layer0_node, layer0_name, layer1_node, layer1_name, layer2_node, layer2_name, weights_0, weights_1, weights_2, {sql9('raw')} AS raw_importance FROM cw""")
def connection_weights(v: Views) -> DataFrame:
    return rounded(paths(v), "raw_importance")


@query("topology weights", f"""
    WITH p AS (SELECT w0.src AS input, f0, f1, (w0.w + f0 * 0.5e0) * (w1.w - f1 * 0.25e0) * w2.w AS v
               FROM weights w0 JOIN weights w1 ON w0.layer = 0 AND w1.layer = 1 AND w0.dst = w1.src
               JOIN weights w2 ON w2.layer = 2 AND w1.dst = w2.src, (SELECT unnest([0, 1]) AS f0), (SELECT unnest([0, 1]) AS f1)),
    t AS (SELECT input, f0 * 2 + f1 AS filter, v FROM p), s AS (SELECT filter, sum(abs(v)) AS total FROM t GROUP BY filter)
    SELECT input, filter, {sql9('v')} AS importance, {sql9('100 * abs(v) / total')} AS percentage FROM t JOIN s USING (filter)""")
def input_importance(v: Views) -> DataFrame:
    copies = F.explode(F.when(F.col("layer") < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("filter")
    shift = F.when(F.col("layer") == 0, F.col("filter") * 0.5).otherwise(F.col("filter") * -0.25)
    weights = v.weights.select("*", copies).withColumn("w", F.col("w") + shift)
    return rounded(i.input_importance(weights), "importance", "percentage")


@query("topology weights", f"""WITH {PATHS}, t AS (SELECT sum(abs(raw)) AS total FROM cw),
    s AS (SELECT 0 AS level, layer0_name AS name, abs(raw) AS a FROM cw UNION ALL SELECT 1, layer1_name, abs(raw) FROM cw
          UNION ALL SELECT 2, layer2_name, abs(raw) FROM cw)
    SELECT level, name, {sql9('100 * sum(a) / max(total)')} AS share FROM s, t GROUP BY level, name HAVING 100 * sum(a) / max(total) > 0.01e0""")
def importance_rollup(v: Views) -> DataFrame:
    return rounded(i.importance_rollup(paths(v), [0, 1, 2]), "share")


@query("topology weights", f"""WITH {WITH_CHR},
    e AS (SELECT DISTINCT chr, layer0_node, layer0_name, layer1_node, layer1_name, weights_0 AS w FROM cw)
    SELECT chr, layer0_node, layer0_name, layer1_node, layer1_name, w, row_number() OVER (ORDER BY chr, layer0_node, layer1_node) - 1 AS pos,
           {sql9('abs(w) / max(abs(w)) OVER ()')} AS plot_weight FROM e""")
def layer_weight_table(v: Views) -> DataFrame:
    return rounded(i.layer_weight_table(paths_with_chr(v), 0), "plot_weight")


@query("topology weights", f"""WITH {PATHS}, e AS (SELECT DISTINCT layer2_node, layer2_name, weights_2 AS w FROM cw)
    SELECT layer2_node, layer2_name, w, CAST(0 AS BIGINT) AS layer3_node, 'end_node' AS layer3_name,
           row_number() OVER (ORDER BY layer2_node) - 1 AS pos, {sql9('abs(w) / max(abs(w)) OVER ()')} AS plot_weight FROM e""")
def last_layer_weight_table(v: Views) -> DataFrame:
    return rounded(i.layer_weight_table(paths(v), 2), "plot_weight")


@query("topology weights", f"""WITH {WITH_CHR}
    SELECT chr, layer0_node, layer1_node, layer2_node, layer0_name, layer1_name, layer2_name, {sql9('raw')} AS raw_importance,
           row_number() OVER (ORDER BY chr, layer0_node, layer1_node, layer2_node) - 1 AS pos, {sql9('abs(raw) / max(abs(raw)) OVER ()')} AS relative FROM cw""")
def manhattan_table(v: Views) -> DataFrame:
    return rounded(i.manhattan_table(paths_with_chr(v)), "raw_importance", "relative")


@query("topology weights", f"""WITH {WITH_CHR},
    p AS (SELECT chr, row_number() OVER (ORDER BY chr, layer0_node, layer1_node, layer2_node) - 1 AS pos FROM cw),
    e AS (SELECT chr, max(pos) + 1 AS "end" FROM p GROUP BY chr)
    SELECT chr, start, "end", {sql9('(start + "end") / 2')} AS middle
    FROM (SELECT chr, "end", coalesce(lag("end") OVER (ORDER BY "end"), 0) AS start FROM e)""")
def chromosome_bounds(v: Views) -> DataFrame:
    return rounded(i.group_bounds(i.manhattan_table(paths_with_chr(v))), "middle")


@query("topology weights", f"""WITH {PATHS}
    SELECT layer0_name, {sql9('abs(raw)')} AS importance FROM cw ORDER BY abs(raw) DESC, layer0_name LIMIT 10""")
def strongest_paths(v: Views) -> DataFrame:
    table = paths(v).withColumn("importance", F.abs("raw_importance"))
    return rounded(top_hits(table, 10, "importance", "layer0_name").select("layer0_name", "importance"), "importance")


DOWN = """
    down AS (SELECT w1.src AS node, sum(abs(w1.w) * abs(w2.w)) AS down FROM weights w1 JOIN weights w2 ON w1.layer = 1 AND w2.layer = 2
             AND w1.dst = w2.src GROUP BY w1.src),
    ranked AS (SELECT dst AS gene, src, abs(w) AS size, row_number() OVER (PARTITION BY dst ORDER BY abs(w) DESC, src) AS rank,
                      down FROM weights JOIN down ON layer = 0 AND node = dst)"""


@query("weights", f"WITH {DOWN} SELECT node, {sql9('down')} AS down FROM down")
def downstream_weight(v: Views) -> DataFrame:
    return rounded(i.downstream_weight(v.weights, 0), "down")


@query("weights", f"WITH {DOWN} SELECT gene, src, rank, {sql9('size * down')} AS strength, rank - 1 AS partners FROM ranked")
def interaction_profile(v: Views) -> DataFrame:
    """Every pair of every gene, one row per input for all pairs it decides."""
    return rounded(i.interaction_profile(v.w0, i.downstream_weight(v.weights, 0)), "strength")


@query("weights", f"""WITH {DOWN}, fan AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM ranked GROUP BY gene))
    SELECT gene, src, rank, {sql9('size * down')} AS strength, rank - 1 AS partners FROM ranked, fan WHERE rank <= n""")
def interaction_profile_common_size(v: Views) -> DataFrame:
    """The same over as many inputs per gene as the smallest gene has."""
    found = i.interaction_profile(v.w0, i.downstream_weight(v.weights, 0), n=i.smallest_fan_in(v.w0))
    return rounded(found, "strength")


@query("weights", f"""WITH {DOWN}
    SELECT b.gene, a.src AS src_a, b.src AS src_b, {sql9('b.size * b.down')} AS strength FROM ranked a JOIN ranked b ON a.gene = b.gene AND a.rank < b.rank
    ORDER BY b.size * b.down DESC, b.gene, b.rank, a.rank LIMIT 100""")
def strongest_interactions(v: Views) -> DataFrame:
    return rounded(i.top_interactions(v.w0, i.downstream_weight(v.weights, 0), k=100), "strength")


def pair_ranking(v: Views) -> DataFrame:
    """Scored pairs of several runs, from order lines."""
    return v.table("lineitem").selectExpr(
        "l_linenumber AS run", "concat(l_partkey % 50, ' ', l_suppkey % 40, ' ') AS coord", "l_extendedprice * l_discount + l_orderkey / 1e9 AS strength"
    )


RANKING = """
    r AS (SELECT l_linenumber AS run, concat(l_partkey % 50, ' ', l_suppkey % 40, ' ') AS coord,
                 l_extendedprice * l_discount + l_orderkey / 1e9 AS strength FROM lineitem),
    k AS (SELECT *, row_number() OVER ({part}ORDER BY strength DESC, coord) AS rn FROM r),
    y AS (SELECT run, strength AS p, CAST(a % 3 = 0 AND b % 3 = 0 AND a <> b AS INT) AS y FROM
          (SELECT *, CAST(string_split(trim(coord), ' ')[1] AS INT) AS a, CAST(string_split(trim(coord), ' ')[2] AS INT) AS b FROM k WHERE rn <= 100)),
    m AS (SELECT {run}y, rank() OVER ({part}ORDER BY p) + (count(*) OVER (PARTITION BY {run}p) - 1) / 2.0e0 AS r FROM y),
    s AS (SELECT {run}sum(r) FILTER (y = 1) AS s, count(*) FILTER (y = 1) AS np, count(*) FILTER (y = 0) AS nn FROM m {group})"""


def causal(v: Views) -> DataFrame:
    return v.table("part").selectExpr("p_partkey % 50 AS variant_id").filter("variant_id % 3 = 0").distinct()


@query("", f"""WITH {RANKING.format(part='', run='', group='')}
    SELECT {sql9('coalesce((s - np * (np + 1) / 2.0e0) / nullif(np * nn, 0), 0)')} AS auc FROM s""")
def epistasis_auc(v: Views) -> DataFrame:
    return rounded(i.epistasis_auc(pair_ranking(v), causal(v), k=100), "auc")


@query("", f"""WITH {RANKING.format(part='PARTITION BY run ', run='run, ', group='GROUP BY run')}
    SELECT run, {sql9('coalesce((s - np * (np + 1) / 2.0e0) / nullif(np * nn, 0), 0)')} AS auc FROM s""")
def epistasis_auc_per_run(v: Views) -> DataFrame:
    return rounded(i.epistasis_auc(pair_ranking(v), causal(v), k=100, run="run"), "auc")


# ---------------------------------------------------------------- predictors


INPUT_FITS = """
    f0 AS (SELECT variant_id AS node, count(*) AS n, sum(dosage * label_reg) AS xy, sum(dosage * dosage) AS xx, sum(label_reg * label_reg) AS yy,
                  min(dosage) = max(dosage) AS flat FROM genotype JOIN subject USING (subject_id) GROUP BY variant_id),
    r0 AS (SELECT node, CASE WHEN NOT flat THEN 1 - n / (n - 1) * (1 - xy * xy / (xx * yy)) END AS r2 FROM f0)"""
GENE_FITS = Z0 + """,
    f1 AS (SELECT node, count(*) AS n, sum(tanh(z) * label_reg) AS xy, sum(tanh(z) * tanh(z)) AS xx, sum(label_reg * label_reg) AS yy
           FROM z0 JOIN subject USING (subject_id) GROUP BY node),
    r1 AS (SELECT node, 1 - n / (n - 1) * (1 - xy * xy / (xx * yy)) AS r2 FROM f1)"""


def labels(v: Views) -> DataFrame:
    return v.subject.select("subject_id", F.col("label_reg").alias("y"))


def gene_activations(v: Views) -> DataFrame:
    net = small_network(v)
    return n.apply_activation(n.layer_forward(n.as_nodes(v.genotype), *net.layer(0)), "tanh")


@query("genotype subject", f"WITH {INPUT_FITS} SELECT CAST(node AS BIGINT) AS node, {sql9('r2')} AS r2 FROM r0")
def univariate_fit(v: Views) -> DataFrame:
    return rounded(i.univariate_fit(n.as_nodes(v.genotype), labels(v)), "r2")


@query("genotype subject small_weights small_bias", f"""WITH {INPUT_FITS}, {GENE_FITS}
    SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, {sql9('CASE WHEN r1.r2 < 0 THEN 0.0e0 ELSE (r1.r2 - r0.r2) / r0.r2 END')} AS rlipp
    FROM small_weights JOIN r0 ON src = r0.node JOIN r1 ON dst = r1.node WHERE layer = 0""")
def rlipp(v: Views) -> DataFrame:
    edges = v.small_weights.filter("layer = 0").select("src", "dst")
    children = i.univariate_fit(n.as_nodes(v.genotype), labels(v))
    return rounded(i.rlipp(edges, children, i.univariate_fit(gene_activations(v), labels(v))), "rlipp")


#: Variants of a gene in the fixture, at most.
CHILDREN = 8
# The Gram matrix of a gene's variants and the label (last), swept variant by variant; a pivot that
# earlier sweeps brought to 0 adds no rank.
SWEEPS = f"""
    member AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src) AS i FROM (SELECT DISTINCT dst, src FROM small_weights WHERE layer = 0)),
    cell AS (SELECT dst, i, subject_id, CAST(dosage AS DOUBLE) AS x FROM member JOIN genotype ON src = variant_id
             UNION ALL SELECT dst, {CHILDREN + 1}, subject_id, label_reg FROM (SELECT DISTINCT dst FROM member), subject
             WHERE subject_id IN (SELECT subject_id FROM genotype)),
    g0 AS (SELECT a.dst, a.i, b.i AS j, sum(a.x * b.x) AS v FROM cell a JOIN cell b ON a.dst = b.dst AND a.subject_id = b.subject_id GROUP BY ALL),
    t0 AS (SELECT dst, i AS p, v AS size FROM g0 WHERE i = j),
    """ + ",\n    ".join(f"""k{p} AS (SELECT dst, v AS piv FROM g{p - 1} JOIN t0 USING (dst) WHERE i = {p} AND j = {p} AND t0.p = {p} AND v > 1e-9 * size),
    g{p} AS (SELECT g.dst, g.i, g.j, g.v - coalesce(l.v * r.v / piv, 0) AS v FROM g{p - 1} g LEFT JOIN k{p} USING (dst)
             LEFT JOIN g{p - 1} l ON l.dst = k{p}.dst AND l.i = g.i AND l.j = {p} LEFT JOIN g{p - 1} r ON r.dst = k{p}.dst AND r.i = {p} AND r.j = g.j)""" for p in range(1, CHILDREN + 1)) + f""",
    ranks AS (SELECT dst, count(*) AS rank FROM ({' UNION ALL '.join(f'SELECT dst FROM k{p}' for p in range(1, CHILDREN + 1))}) GROUP BY dst),
    rj AS (SELECT dst, 1 - n / (n - rank) * (l.v / f.size) AS r2 FROM g{CHILDREN} l JOIN t0 f USING (dst) JOIN ranks USING (dst),
           (SELECT count(DISTINCT subject_id)::DOUBLE AS n FROM genotype JOIN subject USING (subject_id)) WHERE l.i = {CHILDREN + 1} AND l.j = l.i AND f.p = l.i)"""


@query("genotype subject small_weights small_bias", f"""WITH {GENE_FITS}, {SWEEPS}
    SELECT CAST(dst AS BIGINT) AS dst, {sql9('r1.r2')} AS parent_r2, {sql9('rj.r2')} AS child_r2,
        {sql9('CASE WHEN r1.r2 < 0 THEN 0.0e0 ELSE (r1.r2 - rj.r2) / rj.r2 END')} AS rlipp FROM rj JOIN r1 ON dst = node""")
def rlipp_joint(v: Views) -> DataFrame:
    """Gene fit against the joint fit of its variants, for all genes at once."""
    edges = v.small_weights.filter("layer = 0").select("src", "dst")
    return rounded(i.rlipp_joint(edges, n.as_nodes(v.genotype), gene_activations(v), labels(v)), "parent_r2", "child_r2", "rlipp")


@query("genotype subject", f"""
    WITH RECURSIVE c AS (
        SELECT CAST(variant_id AS BIGINT) AS node, count(*) AS n, sum(label_bin) AS pos, count(*) FILTER (dosage = 1) AS n1, count(*) FILTER (dosage = 2) AS n2,
               count(*) FILTER (dosage = 1 AND label_bin = 1) AS y1, count(*) FILTER (dosage = 2 AND label_bin = 1) AS y2,
               count(DISTINCT dosage) = 1 AS constant
        FROM genotype JOIN subject USING (subject_id) GROUP BY variant_id),
    steps AS (
        SELECT 0 AS step, node, CASE WHEN y1 + y2 BETWEEN 1 AND n1 + n2 - 1 THEN 0.0e0 END AS b FROM c
        UNION ALL
        SELECT step + 1, node, b + (y1 - n1 * p1 + 2 * (y2 - n2 * p2)) / (n1 * p1 * (1 - p1) + 4 * n2 * p2 * (1 - p2))
        FROM (SELECT *, 1 / (1 + exp(-b)) AS p1, 1 / (1 + exp(-2 * b)) AS p2 FROM steps JOIN c USING (node)) WHERE step < 40),
    fitted AS (
        SELECT *, -y1 * ln(1 + exp(-b)) - (n1 - y1) * ln(1 + exp(b)) - y2 * ln(1 + exp(-2 * b)) - (n2 - y2) * ln(1 + exp(2 * b)) - (n - n1 - n2) * ln(2) AS ll,
               pos * ln(pos / n) + (n - pos) * ln(1 - pos / n) AS base
        FROM steps JOIN c USING (node) WHERE step = 40)
    SELECT node, {sql9('b')} AS beta, {sql9('CASE WHEN NOT constant THEN 1 - ll / base END')} AS pseudo_r2 FROM fitted""")
def univariate_logit(v: Views) -> DataFrame:
    """Logistic fit per variant by Newton steps; the SQL takes forty on the counts per dosage."""
    y = v.subject.select("subject_id", F.col("label_bin").alias("y"))
    return rounded(i.univariate_logit(n.as_nodes(v.genotype), y), "beta", "pseudo_r2")


def cases_and_background(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.subject.filter("set_id = 3 AND label_bin = 1"), v.subject.filter("set_id = 2 AND label_bin = 0")


def path_sql(name: str, evaluations: str, cells: str) -> str:
    """Attributions `name` (target, setting, subject_id, variant_id, value) of the evaluations' first sums.

    Midpoints of eight steps from the background; slopes by the chain rule over the three layers.
    """
    keys = "target, setting, subject_id"
    return f"""
    {name}_p AS (SELECT {keys}, a, e.node, zb.z + a * (e.z - zb.z) AS z FROM ({evaluations}) e JOIN zb ON zb.node = e.node,
                 (SELECT (unnest(range(8)) + 0.5e0) / 8 AS a)),
    {name}_1 AS (SELECT {keys}, a, dst AS node, sum(tanh(z) * w) + max(b) AS z FROM {name}_p p JOIN small_weights s ON s.layer = 1 AND src = p.node
                 JOIN small_bias b ON b.layer = 1 AND b.node = dst GROUP BY {keys}, a, dst),
    {name}_2 AS (SELECT {keys}, a, sum(tanh(z) * w) + max(b) AS z FROM {name}_1 p JOIN small_weights s ON s.layer = 2 AND src = p.node
                 JOIN small_bias b ON b.layer = 2 AND b.node = dst GROUP BY {keys}, a),
    {name}_e AS (SELECT {keys}, a, o.node, exp(-t.z) / (1 + exp(-t.z)) ** 2 * w * (1 - tanh(o.z) ** 2) AS d
                 FROM {name}_1 o JOIN {name}_2 t USING ({keys}, a) JOIN small_weights s ON s.layer = 2 AND src = o.node),
    {name}_d AS (SELECT {keys}, node, avg(d) AS d FROM (
                     SELECT {keys}, a, p.node, sum(e.d * w) * (1 - tanh(max(p.z)) ** 2) AS d FROM {name}_p p JOIN small_weights s ON s.layer = 1 AND src = p.node
                     JOIN (SELECT {keys}, a, node AS dst, d FROM {name}_e) e USING ({keys}, a, dst) GROUP BY {keys}, a, p.node)
                 GROUP BY {keys}, node),
    {name} AS (SELECT {keys}, variant_id, sum((x - base) * w * d) AS value FROM ({cells}) JOIN bg USING (variant_id)
               JOIN small_weights s ON s.layer = 0 AND src = variant_id JOIN {name}_d USING ({keys}) WHERE {name}_d.node = dst
               GROUP BY {keys}, variant_id)"""


ATTRIBUTION_SQL = Z0 + """,
    cases AS (SELECT subject_id FROM subject WHERE set_id = 3 AND label_bin = 1),
    bg AS (SELECT variant_id, avg(dosage) AS base FROM genotype JOIN subject USING (subject_id) WHERE set_id = 2 AND label_bin = 0 GROUP BY variant_id),
    zb AS (SELECT dst AS node, sum(base * w) + max(b) AS z FROM bg JOIN small_weights s ON s.layer = 0 AND src = variant_id
           JOIN small_bias b ON b.layer = 0 AND b.node = dst GROUP BY dst),""" + path_sql(
    "plain",
    "SELECT 0 AS target, 0 AS setting, subject_id, node, z FROM z0 JOIN cases USING (subject_id)",
    "SELECT 0 AS target, 0 AS setting, subject_id, variant_id, dosage AS x FROM genotype JOIN cases USING (subject_id)",
) + """,
    attr AS (SELECT variant_id, max(abs(value)) AS attribution FROM plain GROUP BY variant_id),
    ranked AS (SELECT variant_id, row_number() OVER (ORDER BY attribution DESC, variant_id) - 1 AS rank FROM attr)"""


def perturbed_sql(targets: int, settings: str) -> str:
    """`moved`: attributions with each of the first ranked variants set to each value."""
    chosen = f"(SELECT variant_id AS target FROM ranked WHERE rank < {targets}), (SELECT unnest([{settings}]) AS setting)"
    return path_sql(
        "moved",
        f"""SELECT target, setting, z0.subject_id, z0.node, z + CASE WHEN dst = z0.node THEN (setting - dosage) * w ELSE 0 END AS z
            FROM {chosen}, z0 JOIN cases USING (subject_id) JOIN genotype g ON g.subject_id = z0.subject_id
            JOIN small_weights s ON s.layer = 0 AND src = g.variant_id WHERE g.variant_id = target""",
        f"""SELECT target, setting, subject_id, variant_id, CASE WHEN variant_id = target THEN setting ELSE dosage END AS x
            FROM {chosen}, genotype JOIN cases USING (subject_id)""",
    )


@query("genotype small_weights small_bias subject", f"WITH {ATTRIBUTION_SQL} SELECT variant_id, {sql9('attribution')} AS attribution FROM attr")
def attributions(v: Views) -> DataFrame:
    """Largest attribution of every variant over the test cases."""
    cases, background = cases_and_background(v)
    return rounded(i.attributions(small_network(v), v.genotype, cases, background), "attribution")


@query("genotype small_weights small_bias subject", f"""WITH {ATTRIBUTION_SQL}, {perturbed_sql(5, '0, 1, 2')},
    pairs AS (SELECT a.target, a.variant_id, avg(abs(a.value - b.value)) AS change FROM moved a JOIN moved b USING (target, subject_id, variant_id)
              WHERE a.setting < b.setting GROUP BY a.target, a.variant_id, a.setting, b.setting),
    change AS (SELECT target, variant_id, max(change) AS change FROM pairs GROUP BY target, variant_id),
    other AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY change DESC, variant_id) AS rn FROM change WHERE variant_id <> target)
    SELECT c.target, {sql9('c.change')} AS own, {sql9('o.change')} AS other, o.variant_id AS other_variant
    FROM change c JOIN other o ON o.target = c.target AND rn = 1 WHERE c.variant_id = c.target""")
def perturbation_effects(v: Views) -> DataFrame:
    """Change of all attributions when one of the five top-ranked variants is set to 0, 1 and 2."""
    cases, background = cases_and_background(v)
    net = small_network(v)
    ranked = i.attributions(net, v.genotype, cases, background)
    chosen = rank_slice(ranked, "attribution", "variant_id", 0, 5)
    return rounded(i.dfim(net, v.genotype, cases, background, chosen), "own", "other")


@query("genotype small_weights small_bias subject", f"""WITH {ATTRIBUTION_SQL}, {perturbed_sql(3, '0, 2')}
    SELECT a.target, a.variant_id, {sql9('max(abs(b.value - a.value) / 2)')} AS interaction FROM moved a JOIN moved b USING (target, subject_id, variant_id)
    WHERE a.setting = 0 AND b.setting = 2 GROUP BY a.target, a.variant_id""")
def path_interactions(v: Views) -> DataFrame:
    """Interactions of the three top-ranked variants with all others."""
    cases, background = cases_and_background(v)
    return rounded(i.path_interactions(small_network(v), v.genotype, cases, background, 0, 3), "interaction")
