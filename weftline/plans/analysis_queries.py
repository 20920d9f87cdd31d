"""Queries over a paired analysis: an experiment for each language, its labelled documents as tasks, three arms told from labels and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators.analysis import Analysis, Metric, Plan, analyze
from weftline.plans.registry import query, rounded, table

PLAN = Plan(("base", "a", "b"), "base", "solved", {"chars": Metric(0.1, False), "lines": Metric(0.1, True)}, margin=0.05, min_n=45, resamples=2000, method="auto")


def _analysis(spark, sf_dir) -> Analysis:
    """Arm ``a`` shortens texts by a fifth; ``b`` doubles their lines, and was not run on French documents of more than 3,000 characters."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.regexp_count("text", F.lit("\n")).alias("_nl")), "doc_id")
    n, lines = F.col("n_chars"), F.col("_nl") + 1
    arms = {"base": (F.col("quality"), n, lines), "a": (1 - F.col("toxic"), n - F.floor(n / 5), lines), "b": (F.col("quality") * (1 - F.col("toxic")), n + 1, lines * 2)}
    ran = {"b": (F.col("lang") != "fr") | (n <= 3000)}
    cells = [F.struct(F.lit(arm).alias("arm"), F.lit(m).alias("metric"), F.when(ran.get(arm, F.lit(True)), v.cast("double")).alias("value"), ran.get(arm, F.lit(True)).alias("_ran")) for arm, of in arms.items() for m, v in zip(("solved", "chars", "lines"), of, strict=True)]
    rows = docs.select(F.col("lang").alias("by"), F.col("doc_id").alias("key"), F.explode(F.array(*cells)).alias("_c")).select("by", "key", "_c.*").where("_ran").drop("_ran")
    return analyze(rows, PLAN)


def _phi(z: str) -> str:
    """The distribution function as ``normal_cdf`` approximates it."""
    poly = "0.17087277::DOUBLE"
    for a in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"({a}::DOUBLE + t * {poly})"
    return f"(SELECT CASE WHEN z >= 0 THEN 1 - h ELSE h END FROM (SELECT z, 0.5 * t * exp(-x * x + {poly}) AS h FROM (SELECT z, x, 1 / (1 + 0.5::DOUBLE * x) AS t FROM (SELECT {z} AS z, abs({z}) / sqrt(2.0) AS x))))"


EXACT = "least(1.0, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM unnest(range(0, least(b, c) + 1)) t(i)))"
RESULTS = f"""d AS (SELECT lang, doc_id, n_chars AS n, length(text) - length(replace(text, chr(10), '')) + 1 AS l, quality AS q, toxic AS x FROM labels JOIN documents USING (doc_id)),
st AS (SELECT lang, count(*) AS keys, count(*) FILTER (lang <> 'fr' OR n <= 3000) AS shared FROM d GROUP BY lang),
state AS (SELECT *, CASE WHEN shared < keys THEN 'insufficient-pairing' WHEN shared < 45 THEN 'insufficient-n' ELSE 'ok' END AS status FROM st),
ok AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS m FROM d SEMI JOIN (SELECT lang FROM state WHERE status = 'ok') s ON s.lang = d.lang),
arm AS (SELECT lang, pos, m, q AS bq, n AS bn, l AS bl, unnest([{{'treatment': 'a', 's': 1 - x, 'n': n - n // 5, 'l': l}}, {{'treatment': 'b', 's': q * (1 - x), 'n': n + 1, 'l': 2 * l}}]) AS t FROM ok),
bc AS (SELECT lang, t.treatment AS treatment, count(*) AS n, count(*) FILTER (t.s = 1 AND bq = 0) AS b, count(*) FILTER (t.s = 0 AND bq = 1) AS c, avg(t.s) AS rate, avg(bq) AS base_rate FROM arm GROUP BY ALL),
prim AS (SELECT *, NOT (b + c >= 25 AND least(b, c) >= 5) AS exact FROM bc),
tested AS (SELECT *, CASE WHEN exact THEN {EXACT} WHEN b + c = 0 THEN 1 ELSE 2 * {_phi("(-greatest(abs(b - c) - 1, 0) / sqrt(b + c))")} END AS p, CASE WHEN b + c = 0 THEN 1 ELSE {_phi("(-((b - c) / (b + c) + 0.05::DOUBLE) * sqrt(b + c))")} END AS p_margin, rate - base_rate >= -0.05 AS non_inferior FROM prim)"""
SECOND = f"""{RESULTS},
dif AS (SELECT lang, pos, m, t.treatment AS treatment, unnest([{{'metric': 'chars', 'v': t.n, 'b': bn}}, {{'metric': 'lines', 'v': t.l, 'b': bl}}]) AS x FROM arm),
series AS (SELECT lang, treatment, x.metric AS metric, pos, m, CAST(x.v AS DOUBLE) AS v, CAST(x.b AS DOUBLE) AS b, CAST(x.v - x.b AS DOUBLE) AS d FROM dif),
sizes AS (SELECT DISTINCT m FROM ok),
dr AS (SELECT m, r, (20261002 + ((((r * m + i) & 4294967295)::HUGEINT * 1831565813) & 4294967295)) & 4294967295 AS a FROM (SELECT m, r, unnest(range(1, m + 1)) AS i FROM (SELECT m, unnest(range(0, {PLAN.resamples})) AS r FROM sizes))),
dt AS (SELECT m, r, (xor(a, a >> 15) * (a | 1)) & 4294967295 AS t FROM dr), du AS (SELECT m, r, xor(t, (t + xor(t, t >> 7) * (t | 61)) & 4294967295) AS t FROM dt),
drawn AS (SELECT m, r, CAST(floor(CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296 * m) AS BIGINT) AS pos FROM du),
tot AS (SELECT s.lang, s.treatment, s.metric, drawn.r, sum(s.d) / s.m AS mean FROM series s JOIN drawn ON drawn.m = s.m AND drawn.pos = s.pos GROUP BY s.lang, s.treatment, s.metric, s.m, drawn.r),
ci AS (SELECT lang, treatment, metric, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, count(*) FILTER (mean <= 0) / count(*) AS p_one, least(1.0, 2 * least(count(*) FILTER (mean <= 0), count(*) FILTER (mean >= 0)) / count(*)) AS p FROM tot GROUP BY ALL),
pl AS (SELECT lang, treatment, metric, count(*) AS n, avg(v) AS mean, avg(b) AS base_mean, avg(d) AS difference, quantile_cont(d, 0.5) AS median FROM series GROUP BY ALL),
sec AS (SELECT pl.*, low, high, p_one, p, CASE metric WHEN 'chars' THEN high < -0.1::DOUBLE * base_mean ELSE low > 0.1::DOUBLE * base_mean END AS improves, count(*) OVER (PARTITION BY pl.lang) AS k, row_number() OVER (PARTITION BY pl.lang ORDER BY p, treatment, metric) AS i FROM pl JOIN ci USING (lang, treatment, metric)),
adj AS (SELECT *, max(least(1.0, (k - i + 1) * p)) OVER (PARTITION BY lang ORDER BY p, treatment, metric ROWS UNBOUNDED PRECEDING) AS adjusted FROM sec)"""


@query(f"""WITH {SECOND}, win AS (SELECT lang, bool_or(adjusted <= 0.05 AND improves) AS w FROM adj GROUP BY lang), h AS (SELECT lang, bool_and(non_inferior) AS h FROM tested GROUP BY lang)
SELECT s.lang AS by, status, keys, shared, CASE WHEN status = 'ok' THEN shared END AS pairs, CASE WHEN status = 'ok' THEN h AND coalesce(w, false) END AS success FROM state s LEFT JOIN h ON h.lang = s.lang LEFT JOIN win ON win.lang = s.lang""")
def analysis_verdicts(spark, sf_dir):
    """Which experiments are refused, and what the others come to."""
    return _analysis(spark, sf_dir).experiments


@query(f"""WITH {RESULTS} SELECT lang AS by, 'insufficient-pairing' AS kind, CAST(NULL AS VARCHAR) AS metric, doc_id AS key, 'b' AS missing, CAST(NULL AS BIGINT) AS count FROM d WHERE lang = 'fr' AND n > 3000
UNION ALL SELECT lang, 'insufficient-n', unnest(['solved', 'chars', 'lines']), NULL, '', shared FROM state WHERE status = 'insufficient-n'""")
def analysis_refusals(spark, sf_dir):
    return _analysis(spark, sf_dir).refusals.withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {RESULTS} SELECT lang AS by, treatment, n, b, c, round(rate, 6) AS rate, round(base_rate, 6) AS base_rate, CASE WHEN exact THEN 'exact' ELSE 'asymptotic' END AS test, round(p, 6) AS p, round(p_margin, 6) AS p_margin, p <= 0.05 AS rejects, non_inferior FROM tested")
def analysis_primary(spark, sf_dir):
    return rounded(_analysis(spark, sf_dir).primary, "rate", "base_rate", "p", "p_margin")


@query(f"""WITH {SECOND} SELECT lang AS by, treatment, metric, n, round(mean, 6) AS mean, round(base_mean, 6) AS base_mean, round(difference, 6) AS difference, median, round(low, 6) AS low, round(high, 6) AS high, p_one, p, improves, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS rejects FROM adj""")
def analysis_secondary(spark, sf_dir):
    return rounded(_analysis(spark, sf_dir).secondary.drop("line"), "mean", "base_mean", "difference", "low", "high", "adjusted")
