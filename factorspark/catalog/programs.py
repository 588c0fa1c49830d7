"""Prefix programs, fitness metrics and batch statistics on line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fitness as N
from ..operators import symbolic as Z
from .base import q6, query, r6, table

# X0 quantity, X1 discount, X2 tax, y price in ten thousands, w weight; k identifies a row up to equal rows.
XY_SQL = "xy AS (SELECT l_quantity / 50.0 AS x0, l_discount AS x1, l_tax AS x2, l_extendedprice / 10000.0 AS y, 1.0 + l_linenumber AS w, l_quantity / 10.0 + l_tax AS p FROM lineitem)"


def xy(spark, folder):
    c = F.col
    return table(spark, folder, "lineitem").select(
        (c("l_quantity") / 50.0).alias("x0"), c("l_discount").alias("x1"), c("l_tax").alias("x2"), (c("l_extendedprice") / 10000.0).alias("y"),
        (F.lit(1.0) + c("l_linenumber")).alias("w"), (c("l_quantity") / 10.0 + c("l_tax")).alias("p"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
    )


ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
PROGRAM = "add(mul(X0,X1),sub(div(X2,X1),-0.5))"
PROGRAM_SQL = "x0 * x1 + (CASE WHEN abs(x1) > 0.001 THEN x2 / x1 ELSE 1.0 END - (-0.5))"


@query("prefix_program", f"WITH {XY_SQL} SELECT x0, x1, x2, {q6(PROGRAM_SQL)} AS prediction FROM xy")
def prefix_program(spark, folder):
    out = Z.predict(xy(spark, folder), PROGRAM, ["x0", "x1", "x2"])
    return out.select("x0", "x1", "x2", r6("prediction").alias("prediction"))


@query(
    "program_classes",
    f"""WITH {XY_SQL}, s AS (SELECT 1.0 / (1.0 + exp(-(x0 - 0.51 + x1))) AS p1 FROM xy)
SELECT {q6('p1')} AS p1, {q6('1.0 - p1')} AS p0, CASE WHEN p1 > 0.5 THEN 'dear' ELSE 'cheap' END AS label FROM s""",
)
def program_classes(spark, folder):
    out = Z.classify(xy(spark, folder), "add(sub(X0,0.51),X1)", ["x0", "x1"], ["cheap", "dear"])
    return out.select(r6("p1").alias("p1"), r6("p0").alias("p0"), "label")


@query("program_columns", f"WITH {XY_SQL} SELECT {q6('sqrt(abs(x0 - 0.5))')} AS f0, {q6('CASE WHEN abs(x1) > 0.001 THEN ln(abs(x1)) ELSE 0.0 END')} AS f1, {q6('greatest(x0, x2) * cos(x1)')} AS f2 FROM xy")
def program_columns(spark, folder):
    programs = {"f0": "sqrt(sub(X0,0.5))", "f1": "log(X1)", "f2": "mul(max(X0,X2),cos(X1))"}
    out = Z.transform(xy(spark, folder), programs, ["x0", "x1", "x2"])
    return out.select(*[r6(c).alias(c) for c in programs])


@query("class_weights", f"SELECT doc_id, {q6('(SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY toxic)) * (1.0 + quality)')} AS balanced_weight FROM labels")
def class_weights(spark, folder):
    out = Z.class_weights(table(spark, folder, "labels").withColumn("w", F.lit(1.0) + F.col("quality")), "toxic", "w")
    return out.select("doc_id", r6("balanced_weight").alias("balanced_weight"))


def pearson_sql(y, p, w):
    return (
        f"abs(sum({w} * ({y} - my) * ({p} - mp)) / sqrt(sum({w} * ({y} - my) * ({y} - my)) * sum({w} * ({p} - mp) * ({p} - mp))))"
    )


@query("weighted_pearson", f"WITH {XY_SQL}, m AS (SELECT sum(w * y) / sum(w) AS my, sum(w * p) / sum(w) AS mp FROM xy) SELECT {q6(pearson_sql('y', 'p', 'w'))} AS pearson FROM xy, m")
def weighted_pearson(spark, folder):
    return N.weighted_metrics(xy(spark, folder), ["pearson"], w="w").select(r6("pearson").alias("pearson"))


RANKED_SQL = f"""{XY_SQL}, r AS (SELECT w, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM xy)"""


@query("weighted_spearman", f"WITH {RANKED_SQL}, m AS (SELECT sum(w * ry) / sum(w) AS my, sum(w * rp) / sum(w) AS mp FROM r) SELECT {q6(pearson_sql('ry', 'rp', 'w'))} AS spearman FROM r, m")
def weighted_spearman(spark, folder):
    return N.weighted_metrics(xy(spark, folder), ["spearman"], w="w", unique=ROW).select(r6("spearman").alias("spearman"))


@query("spearman", f"WITH {RANKED_SQL} SELECT {q6('corr(ry, rp)')} AS spearman FROM r")
def spearman(spark, folder):
    return N.spearman(xy(spark, folder), "y", "p", ROW).select(r6("spearman").alias("spearman"))


@query("weighted_errors", f"WITH {XY_SQL} SELECT {q6('sum(w * abs(p - y)) / sum(w)')} AS mae, {q6('sum(w * (p - y) * (p - y)) / sum(w)')} AS mse, {q6('sqrt(sum(w * (p - y) * (p - y)) / sum(w))')} AS rmse FROM xy")
def weighted_errors(spark, folder):
    out = N.weighted_metrics(xy(spark, folder), ["mean absolute error", "mse", "rmse"], w="w")
    return out.select(r6("mean absolute error").alias("mae"), r6("mse").alias("mse"), r6("rmse").alias("rmse"))


@query(
    "registered_metrics",
    f"""WITH {XY_SQL}, r AS (SELECT l_linenumber AS line, y, p, w FROM (SELECT *, l_extendedprice / 10000.0 AS y, l_quantity / 10.0 + l_tax AS p, 1.0 + l_discount AS w FROM lineitem))
SELECT line, {q6('sum(w * abs(p - y)) / sum(w)')} AS mae, {q6('sum(w * (p - y)) / sum(w)')} AS bias,
{q6('1 - sum(w * (y - p) * (y - p)) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w))')} AS r2, {q6('sqrt(sum(w * exp(-y)) / sum(w))')} AS decay FROM r GROUP BY 1""",
)
def registered_metrics(spark, folder):
    """A built-in metric, one registered as a column and two registered in numpy, for every line number."""
    N.register_metric("bias", lambda y, p, w: F.sum(w * (p - y)) / F.sum(w), False)
    N.register_sums_metric("r2", lambda y, p, w: [w.sum(), w @ y, w @ (y * y), w @ (y - p) ** 2], lambda s: 1 - s[3] / (s[2] - s[1] ** 2 / s[0]), 4, True)
    N.register_sums_metric("decay", lambda y, p, w: [w.sum(), sum(w * 2.718281828459045**-y)], lambda s: (s[1] / s[0]) ** 0.5, 2, False)
    d = xy(spark, folder).withColumn("w", F.lit(1.0) + F.col("x1"))
    out = N.grouped_metrics(d, ["mean absolute error", "r2", "bias", "decay"], ["l_linenumber"], w="w")
    return out.select(F.col("l_linenumber").alias("line"), r6("mean absolute error").alias("mae"), r6("bias").alias("bias"), r6("r2").alias("r2"), r6("decay").alias("decay"))


@query("log_loss", f"SELECT {q6('avg(-(toxic * ln(0.1 + 0.8 * quality) + (1 - toxic) * ln(1 - (0.1 + 0.8 * quality))))')} AS log_loss FROM labels")
def log_loss(spark, folder):
    d = table(spark, folder, "labels").select(F.col("toxic").alias("y"), (F.lit(0.1) + F.lit(0.8) * F.col("quality")).alias("p"))
    return N.weighted_metrics(d, ["log loss"]).select(r6("log loss").alias("log_loss"))


@query(
    "regression_metrics",
    f"""WITH {XY_SQL}, b AS (SELECT avg((y - p) * (y - p)) AS m, var_pop(y) AS v, avg(CASE WHEN abs(y - p) < 0.1 * abs(y) + 0.5 THEN 1.0 ELSE 0.0 END) AS fraction, corr(y, p) AS pearson FROM xy)
SELECT {q6('-m')} AS neg_mse, {q6('-sqrt(m)')} AS neg_rmse, {q6('-m / v')} AS neg_nmse, {q6('-sqrt(m / v)')} AS neg_nrmse, {q6('-ln(1 + m)')} AS neglog_mse, {q6('1 / (1 + 0.5 * m)')} AS inv_mse,
{q6('1 / (1 + 0.5 * m / v)')} AS inv_nmse, {q6('1 / (1 + 0.5 * sqrt(m / v))')} AS inv_nrmse, {q6('fraction')} AS fraction, {q6('pearson')} AS pearson FROM b""",
)
def regression_metrics(spark, folder):
    out = N.regression_metrics(xy(spark, folder), "y", "p", scale=0.5, band=(0.1, 0.5))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(
    "split_fitness",
    f"""WITH {XY_SQL}, parts AS (SELECT 'hash' AS part, y, p, w FROM xy
UNION ALL SELECT CASE WHEN l_orderkey % 10 < 7 THEN 'in' ELSE 'out' END, l_extendedprice / 10000.0, l_quantity / 10.0 + l_tax, 1.0 + l_linenumber FROM lineitem)
SELECT part, count(*) AS n, {q6('sum(w * (p - y) * (p - y)) / sum(w)')} AS error FROM parts GROUP BY 1""",
)
def split_fitness(spark, folder):
    """Both parts of a given split, and of the hash split both put together (the parts depend on our own hash)."""

    def parts(d):
        sizes = d.groupBy("in_sample").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
        return N.split_fitness(d, "mse", "y", "p", "w").join(sizes, "in_sample")

    d = xy(spark, folder)
    hashed = parts(N.with_split(d, ROW, 0.7, 42)).agg(F.sum("n").alias("n"), r6(F.sum(F.col("fitness") * F.col("w")) / F.sum("w")).alias("error"))
    given = parts(d.withColumn("in_sample", F.col("l_orderkey") % 10 < 7))
    return hashed.select(F.lit("hash").alias("part"), "n", "error").unionByName(
        given.select(F.when(F.col("in_sample"), "in").otherwise("out").alias("part"), "n", r6("fitness").alias("error"))
    )


PROGRAMS_SQL = "programs AS (SELECT p_name || p_partkey AS expr, p_size AS length, p_retailprice / 100.0 AS fitness, p_brand AS generation FROM part)"


def programs(spark, folder):
    p = table(spark, folder, "part")
    return p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("expr"), F.col("p_size").alias("length"), (F.col("p_retailprice") / 100.0).alias("fitness"), F.col("p_brand").alias("generation"))


@query("parsimony_fitness", f"WITH {PROGRAMS_SQL}, c AS (SELECT covar_samp(length, fitness) / var_pop(length) AS c FROM programs) SELECT expr, {q6('fitness - c * length')} AS penalised FROM programs, c")
def parsimony_fitness(spark, folder):
    return N.parsimony_fitness(programs(spark, folder)).select("expr", r6("penalised").alias("penalised"))


@query("weighted_quantile", f"WITH {XY_SQL}, c AS (SELECT y, sum(w) AS w FROM xy GROUP BY 1), r AS (SELECT y, sum(w) OVER (ORDER BY y) AS cum FROM c) SELECT min(y) AS quantile FROM r WHERE cum >= 0.35 * (SELECT sum(w) FROM xy)")
def weighted_quantile(spark, folder):
    d = xy(spark, folder)
    total = d.agg(F.sum("w")).scalar()
    return N.weighted_quantile(d, "y", "w", total * 0.35)


@query("entropy", f"WITH c AS (SELECT p_size % 4 AS g, p_brand, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY g) AS DOUBLE) AS p FROM c) SELECT g, {q6('-sum(p * ln(p))')} AS entropy FROM t GROUP BY 1")
def entropy(spark, folder):
    d = table(spark, folder, "part").select((F.col("p_size") % 4).alias("g"), "p_brand")
    return N.entropy(d, "p_brand", ["g"]).withColumn("entropy", r6("entropy"))


@query(
    "batch_statistics",
    f"""WITH b AS (SELECT p_name AS expr, p_retailprice / 100.0 AS r, p_size AS length, p_size % 9 = 0 AS invalid, [p_brand, p_type] AS tokens FROM part WHERE p_size > 10),
h AS (SELECT DISTINCT p_name AS expr FROM part WHERE p_size <= 10),
e AS (SELECT pos, tok, count(*) AS n FROM (SELECT 0 AS pos, tokens[1] AS tok FROM b UNION ALL SELECT 1, tokens[2] FROM b) GROUP BY 1, 2),
p AS (SELECT pos, n / CAST(sum(n) OVER (PARTITION BY pos) AS DOUBLE) AS p FROM e), ent AS (SELECT pos, -sum(p * ln(p)) AS v FROM p GROUP BY 1)
SELECT {q6('max(r)')} AS r_best, {q6('avg(r)')} AS r_mean, {q6('avg(length)')} AS length_mean, {q6('avg(CASE WHEN invalid THEN 1.0 ELSE 0.0 END)')} AS invalid_rate, count(DISTINCT expr) AS n_unique,
(SELECT count(DISTINCT expr) FROM b WHERE expr NOT IN (SELECT expr FROM h)) AS n_novel, {q6('(SELECT avg(v) FROM ent)')} AS positional_entropy FROM b""",
)
def batch_statistics(spark, folder):
    p = table(spark, folder, "part")
    b = p.filter("p_size > 10").select(F.col("p_name").alias("expr"), (F.col("p_retailprice") / 100.0).alias("r"), F.col("p_size").alias("length"), (F.col("p_size") % 9 == 0).alias("invalid"), F.array("p_brand", "p_type").alias("tokens"))
    out = N.batch_statistics(b, p.filter("p_size <= 10").select(F.col("p_name").alias("expr")), "tokens")
    return out.select("n_unique", "n_novel", *[r6(c).alias(c) for c in ("r_best", "r_mean", "length_mean", "invalid_rate", "positional_entropy")])


@query("quantile_filter", f"WITH {PROGRAMS_SQL}, o AS (SELECT fitness, row_number() OVER (ORDER BY fitness) - 1 AS k FROM programs), t AS (SELECT fitness AS t FROM o WHERE k = ceil((SELECT count(*) - 1 FROM programs) * 0.9 - 1e-9)) SELECT expr, fitness FROM programs, t WHERE fitness >= t")
def quantile_filter(spark, folder):
    return N.quantile_filter(programs(spark, folder).select("expr", "fitness"), "fitness", 0.1, ["expr"])


@query("hall_of_fame", f"WITH {PROGRAMS_SQL} SELECT expr, max(fitness) AS fitness FROM programs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def hall_of_fame(spark, folder):
    return N.hall_of_fame(programs(spark, folder), 15, "fitness")


FRONT_SQL = """costs AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS b, 1000.0 - p_retailprice AS c FROM part)"""


@query("pareto_front", f"WITH {PROGRAMS_SQL}, best AS (SELECT length, max(fitness) AS fitness FROM programs GROUP BY 1), f AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM best o WHERE o.length < b.length AND o.fitness >= b.fitness)) SELECT f.length, f.fitness, min(p.expr) AS expr FROM f JOIN programs p ON p.length = f.length AND p.fitness = f.fitness GROUP BY 1, 2")
def pareto_front(spark, folder):
    return N.pareto_front(programs(spark, folder), "length", "fitness")


@query("skyline", f"WITH {FRONT_SQL}, u AS (SELECT a, b, c, min(id) AS id FROM costs GROUP BY 1, 2, 3) SELECT a, b, c, id FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE y.a <= x.a AND y.b <= x.b AND y.c <= x.c AND (y.a < x.a OR y.b < x.b OR y.c < x.c))")
def skyline(spark, folder):
    p = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), ((F.col("p_partkey") * 7919) % 1009).cast("double").alias("b"), (F.lit(1000.0) - F.col("p_retailprice")).alias("c")
    )
    return N.skyline(p, ["a", "b", "c"], "id").select("a", "b", "c", "id")


# Programs that resemble each other, over line items.
HALL = {
    "X0": "x0", "add(X0,X1)": "x0 + x1", "mul(X0,X0)": "x0 * x0", "sub(X0,X2)": "x0 - x2", "sqrt(X0)": "sqrt(abs(x0))", "X1": "x1", "mul(X0,X1)": "x0 * x1",
    "X2": "x2", "add(X1,X2)": "x1 + x2", "mul(X0,X2)": "x0 * x2", "cos(X1)": "cos(x1)", "sub(1.0,X0)": "1.0 - x0",
}


def hall_sql(source: str, hall: int = 9, keep: int = 4) -> str:
    """Fitness, the hall, its pairs by closeness, and the walk that drops the worse of each."""
    n = len(HALL)
    fitness = ", ".join(f"round(abs(corr(f{i}, y)), 12)" for i in range(n))
    pairs = ", ".join("[" + ", ".join(f"round(abs(corr(f{i}, f{j})), 12)" for j in range(n)) + "]" for i in range(n))
    return f"""WITH RECURSIVE {source},
c AS (SELECT [{fitness}] AS fit, [{pairs}] AS m FROM v),
h AS (SELECT row_number() OVER (ORDER BY fit[k] DESC, program) - 1 AS pos, k, program, fit[k] AS fitness, m
  FROM c, (VALUES {", ".join(f"({i + 1}, '{p}')" for i, p in enumerate(HALL))}) t(k, program) QUALIFY pos < {hall}),
pr AS (SELECT a.pos AS i, b.pos AS j, row_number() OVER (ORDER BY a.m[a.k][b.k] DESC, a.pos, b.pos) AS nr FROM h a JOIN h b ON a.pos < b.pos),
walk(nr, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[])
  UNION ALL
  SELECT pr.nr, CASE WHEN len(gone) < {hall - keep} AND NOT list_contains(gone, i) AND NOT list_contains(gone, j) THEN list_append(gone, j) ELSE gone END
  FROM walk JOIN pr ON pr.nr = walk.nr + 1),
final AS (SELECT gone FROM walk ORDER BY nr DESC LIMIT 1)
SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INTEGER) AS rank, program, {q6("fitness")} AS fitness FROM h, final WHERE NOT list_contains(gone, pos)"""


HALL_VALUES = f"{XY_SQL}, v AS (SELECT {', '.join(f'{e} AS f{i}' for i, e in enumerate(HALL.values()))}, y FROM xy)"
HALL_RANKS = HALL_VALUES.replace(", v AS", ", u AS") + ", v AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in [*(f"f{i}" for i in range(len(HALL))), "y"]
) + " FROM u)"


def decorrelated(spark, folder, ranks):
    columns = {p: Z.program_column(p, ["x0", "x1", "x2"]) for p in HALL}
    out = N.decorrelated_programs(xy(spark, folder), columns, "y", 9, 4, ranks)
    return out.withColumn("fitness", r6("fitness"))


@query("hall_decorrelated", hall_sql(HALL_VALUES))
def hall_decorrelated(spark, folder):
    return decorrelated(spark, folder, False)


@query("hall_decorrelated_ranks", hall_sql(HALL_RANKS))
def hall_decorrelated_ranks(spark, folder):
    return decorrelated(spark, folder, True)


# Two inputs between 0 and 1, and a target with several true terms.
QUADRATIC = ["1.0", "x0", "x2", "x0 * x0", "x0 * x2", "x2 * x2"]
FIT_SQL = "fit AS (SELECT x0, 10.0 * x1 AS x2, y + 0.5 * x0 * x0 - 10.0 * x1 AS z FROM xy)"


def fit_rows(spark, folder):
    d = xy(spark, folder)
    x2 = F.lit(10.0) * F.col("x1")
    return d.select("x0", x2.alias("x2"), (F.col("y") + 0.5 * F.col("x0") * F.col("x0") - x2).alias("z"))


def sums_sql(name: str, terms: list[str], target: str = "z") -> str:
    """All products of the terms and the target, summed; the target comes last."""
    cells = [*terms, target]
    pairs = ", ".join(f"({i}, {j}, (SELECT sum(({a}) * ({b})) FROM fit))" for i, a in enumerate(cells) for j, b in enumerate(cells))
    return f"{name}0(i, j, v) AS MATERIALIZED (VALUES {pairs})"


def sweeps_sql(name: str, k: int, start: str | None = None, gate: str = "true") -> str:
    """Sweep the sums on each of k terms that pass the gate: coefficients in the last column, minus the inverse in the rest."""
    out = []
    for at in range(k):
        m = start if at == 0 and start else f"{name}{at}"
        out.append(
            f"""{name}{at + 1} AS MATERIALIZED (SELECT m.i, m.j, CASE WHEN NOT ({gate.format(at=at)}) THEN m.v WHEN m.i = {at} AND m.j = {at} THEN -1.0 / p.v
WHEN m.i = {at} OR m.j = {at} THEN m.v / p.v ELSE m.v - r.v * c.v / p.v END AS v
FROM {m} m JOIN {m} p ON p.i = {at} AND p.j = {at} JOIN {m} r ON r.i = m.i AND r.j = {at} JOIN {m} c ON c.i = {at} AND c.j = m.j)"""
        )
    return ", ".join(out)


def fitted_sql(coefficients: str, terms: list[str]) -> str:
    return " + ".join(f"coalesce((SELECT v FROM {coefficients} WHERE i = {i} AND j = {len(terms)}), 0) * ({t})" for i, t in enumerate(terms))


@query("polynomial_fit", f"WITH {XY_SQL}, {FIT_SQL}, {sums_sql('s', QUADRATIC)}, {sweeps_sql('s', 6)} SELECT x0, x2, {q6(fitted_sql('s6', QUADRATIC))} AS fitted FROM fit")
def polynomial_fit(spark, folder):
    """All six terms of two inputs up to degree 2."""
    d = fit_rows(spark, folder)
    model = Z.fit_polynomial(d, ["x0", "x2"], "z", 2)
    return d.select("x0", "x2", r6(model.column()).alias("fitted"))


@query(
    "polynomial_iterated",
    f"WITH {XY_SQL}, {FIT_SQL}, {sums_sql('s', QUADRATIC)}, {sweeps_sql('s', 6)} SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {q6(f'(SELECT v FROM s6 WHERE i = {i} AND j = 6)')})" for i in range(6)) + ") t(term, coefficient)",
)
def polynomial_iterated(spark, folder):
    """The same model by conjugate gradients, as fits of very many terms run."""
    model = Z.fit_polynomial(fit_rows(spark, folder), ["x0", "x2"], "z", 2, tolerance=1e-12, direct_terms=0)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(model.coefficients)], "term int, coefficient double").withColumn("coefficient", r6("coefficient"))


# With thousands of rows 1 % of the t distribution lies outside 2.5758 and a little.
T_SQL = """t AS MATERIALIZED (SELECT i, abs(b.v) / sqrt(-d.v * rss.v / (SELECT count(*) - 6 FROM fit)) AS t FROM s6 b JOIN s6 d USING (i) JOIN s6 rss ON rss.i = 6 AND rss.j = 6 WHERE b.j = 6 AND d.j = b.i AND b.i < 6),
kept AS MATERIALIZED (SELECT i FROM t WHERE t >= 2.5765 QUALIFY row_number() OVER (ORDER BY t DESC) <= 3)"""


@query(
    "polynomial_terms",
    f"""WITH {XY_SQL}, {FIT_SQL}, {sums_sql('s', QUADRATIC)}, {sweeps_sql('s', 6)}, {T_SQL},
{sweeps_sql('g', 6, 's0', '{at} IN (SELECT i FROM kept)')}, w(i, j, v) AS (SELECT i, j, v FROM g6 WHERE i IN (SELECT i FROM kept))
SELECT x0, x2, {q6(fitted_sql('w', QUADRATIC))} AS fitted, (SELECT count(*) FROM kept) AS terms FROM fit""",
)
def polynomial_terms(spark, folder):
    """The three terms of the largest t values, fitted again."""
    d = fit_rows(spark, folder)
    model = Z.fit_polynomial(d, ["x0", "x2"], "z", 2, cutoff_p_value=0.01, max_terms=3)
    terms = sum(1 for c in model.coefficients if c)
    return d.select("x0", "x2", r6(model.column()).alias("fitted"), F.lit(terms).cast("long").alias("terms"))


def lasso_sql(terms: list[str], gamma: float, sweeps: int = 3000) -> str:
    """Coordinate descent over the sums, one step of the recursion for a coordinate."""
    k = len(terms)
    pull = " + ".join(f"b[{i + 1}] * q[{i + 1}]" for i in range(k))
    return f"""{sums_sql('s', terms)}, rows AS MATERIALIZED (SELECT i, list(v ORDER BY j) AS q FROM s0 GROUP BY 1),
lim AS MATERIALIZED (SELECT count(*) / {k}.0 * var_pop(z) * {gamma} AS lim FROM fit),
descent(nr, b) AS (SELECT 0, [{', '.join(['0.0::DOUBLE'] * k)}]
UNION ALL SELECT nr + 1, [CASE WHEN i = c - 1 THEN sign(p) * greatest(abs(p) - lim, 0.0) / q[c] ELSE b[i + 1] END FOR i IN range({k})]
FROM (SELECT nr, b, q, lim, nr % {k} + 1 AS c, q[{k + 1}] - ({pull}) + q[nr % {k} + 1] * b[nr % {k} + 1] AS p FROM descent JOIN rows ON rows.i = nr % {k}, lim WHERE nr < {sweeps})),
final AS (SELECT b FROM descent WHERE nr = {sweeps})"""


LINEAR = ["1.0", "x0", "x2"]
LASSO_SQL = f"WITH RECURSIVE {XY_SQL}, {FIT_SQL}, {lasso_sql(LINEAR, 0.2)} SELECT i AS term, {q6('b[i + 1]')} AS coefficient FROM final, (VALUES (0), (1), (2)) t(i)"


def lasso_terms(spark, folder, **how):
    model = Z.fit_lasso(fit_rows(spark, folder), ["x0", "x2"], "z", 1, 0.2, refit=False, **how)
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(model.coefficients)], "term int, coefficient double").withColumn("coefficient", r6("coefficient"))


@query("lasso_fit", LASSO_SQL)
def lasso_fit(spark, folder):
    """A penalty that shrinks every coefficient, without a second fit."""
    return lasso_terms(spark, folder)


@query("lasso_iterated", LASSO_SQL)
def lasso_iterated(spark, folder):
    """The same by proximal gradients over the rows, as fits of very many terms run."""
    return lasso_terms(spark, folder, tolerance=1e-11, direct_terms=0)
