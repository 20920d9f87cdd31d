"""A paired comparison of arms as one pass over all experiments: what is refused and why, tests, one family of adjusted tests, and a verdict."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.stats import asymptotic_fits, mcnemar_asymptotic, mcnemar_exact, shifted_margin
from weftline.operators.checkpoints import checkpointed
from weftline.operators.paired import discordance, resampled


@dataclass(frozen=True)
class Metric:
    """A secondary metric: by how much of the baseline's mean its interval must be better, and which way better is."""

    improvement: float = 0.1
    higher_is_better: bool = True


@dataclass(frozen=True)
class Plan:
    """What is compared: ``primary`` is a metric of 0 and 1, ``family`` are the others. ``method`` is exact, asymptotic or auto."""

    arms: tuple[str, ...]
    baseline: str
    primary: str
    family: dict[str, Metric] = field(default_factory=dict)
    margin: float = 0.0
    alpha: float = 0.05
    min_n: int = 20
    resamples: int = 10_000
    seed: int = 20261002
    allow_drop: bool = False
    method: str = "exact"

    def __post_init__(self) -> None:
        wrong = {
            "two different arms at least": len(self.arms) < 2 or len(set(self.arms)) != len(self.arms) or not all(self.arms),
            "the baseline is an arm": self.baseline not in self.arms,
            "the primary metric is in no family": self.primary in self.family or not self.primary,
            "a margin is at least 0": not self.margin >= 0,
            "alpha is in (0, 1)": not 0 < self.alpha < 1,
            "one pair and one resample at least": self.min_n < 1 or self.resamples < 1,
            "the method is exact, asymptotic or auto": self.method not in ("exact", "asymptotic", "auto"),
            "the exact test has no margin": self.method == "exact" and self.margin != 0,
        }
        if failed := [rule for rule, broken in wrong.items() if broken]:
            raise ValueError("; ".join(failed))

    @property
    def treatments(self) -> tuple[str, ...]:
        return tuple(a for a in self.arms if a != self.baseline)


@dataclass(frozen=True)
class Analysis:
    """``experiments`` (by, status, keys, shared, pairs, success), ``refusals`` (by, kind, metric, key, missing, count), ``primary`` and ``secondary``: one row for
    each treatment, and for each treatment and metric of the family; of experiments that are refused, none."""

    experiments: DataFrame
    refusals: DataFrame
    primary: DataFrame
    secondary: DataFrame


def analyze(results: DataFrame, plan: Plan) -> Analysis:
    """The comparison of every experiment ``by`` in (by, key, arm, metric, value), by the plan.

    Keys that an arm didn't run, and shared keys without a value of a metric in some arm (null counts as none), are refusals: with ``allow_drop`` they are left out, else
    their experiment is refused (``insufficient-pairing``). So are experiments of which a metric has fewer than ``min_n`` pairs (``insufficient-n``). A task key is run by an
    arm if there is any row of it. Rows of other arms are an error; a repeated row counts once, by its greatest value.

    The family's tests are adjusted together over treatments and metrics. An experiment succeeds if every treatment's rate of the primary metric is within the
    margin, and some metric of some treatment is rejected after adjustment and better by its own criterion.
    """
    metrics = [plan.primary, *plan.family]
    strange = ~F.col("arm").isin(*plan.arms)
    arm = F.when(strange | F.col("arm").isNull(), F.raise_error(F.concat(F.lit("no such arm: "), F.coalesce("arm", F.lit("null"))))).otherwise(F.col("arm"))
    known = checkpointed(results.withColumn("arm", arm).groupBy("by", "key", "arm", "metric").agg(F.max("value").alias("value")))

    ran = known.groupBy("by", "key").agg(F.collect_set("arm").alias("_arms"))
    lists = F.array(*[F.lit(a) for a in plan.arms])
    keys = checkpointed(ran.select("by", "key", F.array_except(lists, "_arms").alias("missing")))
    lost = keys.where(F.size("missing") > 0).select("by", F.lit("insufficient-pairing").alias("kind"), F.lit(None).cast("string").alias("metric"), "key", "missing", F.lit(None).cast("long").alias("count"))
    shared = keys.where(F.size("missing") == 0).select("by", "key")

    wide = known.join(shared, ["by", "key"], "left_semi").groupBy("by", "key").pivot("arm", list(plan.arms)).agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull() & F.col("metric").isin(*metrics), F.struct("metric", "value")))).alias("v"))
    values = wide.select("by", "key", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"), *plan.arms)
    values = checkpointed(values.select("by", "key", "metric", *[F.try_element_at(a, F.col("metric")).alias(a) for a in plan.arms]))
    absent = F.array_compact(F.array(*[F.when(F.col(a).isNull(), F.lit(a)) for a in plan.arms]))
    holes = values.select("by", F.lit("insufficient-pairing").alias("kind"), "metric", "key", absent.alias("missing"), F.lit(None).cast("long").alias("count")).where(F.size("missing") > 0)
    usable = values.where(F.size(absent) == 0)

    counts = usable.groupBy("by", "metric").agg(F.count("*").alias("_n"))
    each = keys.select("by").distinct().select("by", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric")).join(counts, ["by", "metric"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    whole = keys.groupBy("by").agg(F.count("*").alias("keys"), F.count_if(F.size("missing") == 0).alias("shared"))
    unpaired = lost.select("by").unionByName(holes.select("by")).distinct().withColumn("_unpaired", F.lit(not plan.allow_drop))
    sized = each.groupBy("by").agg(F.min("_n").alias("_least"), F.max(F.when(F.col("metric") == plan.primary, F.col("_n"))).alias("pairs"))
    status = F.when(F.col("_unpaired"), "insufficient-pairing").when(F.col("_least") < plan.min_n, "insufficient-n").otherwise("ok")
    state = checkpointed(whole.join(sized, "by").join(unpaired, "by", "left").withColumn("status", status))
    ok = state.where("status = 'ok'").select("by")
    few = each.join(state.where("status = 'insufficient-n'").select("by"), "by", "left_semi").where(F.col("_n") < plan.min_n)
    refusals = lost.unionByName(holes).unionByName(few.select("by", F.lit("insufficient-n").alias("kind"), "metric", F.lit(None).cast(dict(keys.dtypes)["key"]).alias("key"), F.array().cast("array<string>").alias("missing"), F.col("_n").alias("count")))

    pairs = usable.join(ok, "by", "left_semi").select("by", "key", "metric", F.col(plan.baseline).alias("base"), F.explode(F.array(*[F.struct(F.lit(a).alias("treatment"), F.col(a).alias("value")) for a in plan.treatments])).alias("_t")).select("by", "key", "metric", "base", "_t.*")
    binary = pairs.where(F.col("metric") == plan.primary)
    checked = lambda c: F.when(F.col(c).isin(0, 1), F.col(c)).otherwise(F.raise_error(F.lit(f"{plan.primary} must be 0 or 1")))
    counted = discordance(binary.select("by", "treatment", checked("value").alias("x"), checked("base").alias("y")), ["by", "treatment"])
    rates = binary.groupBy("by", "treatment").agg(F.avg("value").alias("rate"), F.avg("base").alias("base_rate"))
    b, c = F.col("b"), F.col("c")
    exact = {"exact": F.lit(True), "asymptotic": F.lit(False), "auto": ~asymptotic_fits(b, c)}[plan.method]
    p = F.when(exact, mcnemar_exact(b, c)).otherwise(mcnemar_asymptotic(b, c))
    primary = counted.join(rates, ["by", "treatment"]).withColumn("test", F.when(exact, "exact").otherwise("asymptotic")).withColumn("p", p)
    primary = primary.withColumn("p_margin", F.col("p") if plan.margin == 0 else shifted_margin(b, c, plan.margin)).withColumn("rejects", F.col("p") <= plan.alpha).withColumn("non_inferior", F.col("rate") - F.col("base_rate") >= -plan.margin)
    primary = checkpointed(primary.select("by", "treatment", "n", "b", "c", "rate", "base_rate", "test", "p", "p_margin", "rejects", "non_inferior"))

    series = ["by", "treatment", "metric"]
    differences = pairs.where(F.col("metric").isin(*plan.family) if plan.family else F.lit(False)).withColumn("d", F.col("value") - F.col("base"))
    placed = differences.withColumn("pos", F.row_number().over(W.partitionBy(*series).orderBy("key")) - 1).join(counts.withColumnRenamed("_n", "n"), ["by", "metric"])
    mean = F.col("total") / F.col("n")
    below, above, n = F.count_if(mean <= 0), F.count_if(mean >= 0), F.count("*")
    intervals = resampled(placed, series, plan.resamples, plan.seed).groupBy(*series).agg(
        F.percentile(mean, F.lit(0.025)).alias("low"), F.percentile(mean, F.lit(0.975)).alias("high"), (below / n).alias("p_one"), F.least(F.lit(1.0), 2 * F.least(below, above) / n).alias("p")
    )
    plain = differences.groupBy(*series).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg("base").alias("base_mean"), F.avg("d").alias("difference"), F.percentile("d", F.lit(0.5)).alias("median"))
    rules = F.create_map(*[x for m, r in plan.family.items() for x in (F.lit(m), F.struct(F.lit(float(r.improvement)).alias("rel"), F.lit(r.higher_is_better).alias("up")))]) if plan.family else F.lit(None).cast("map<string, struct<rel: double, up: boolean>>")
    both = plain.join(intervals, series).withColumn("_r", rules[F.col("metric")])
    line = F.when(F.col("_r.up"), 1.0).otherwise(-1.0) * F.col("_r.rel") * F.col("base_mean")
    both = both.withColumn("line", line).withColumn("improves", F.when(F.col("_r.up"), F.col("low") > F.col("line")).otherwise(F.col("high") < F.col("line"))).drop("_r")
    family, order = W.partitionBy("by"), W.partitionBy("by").orderBy("p", "treatment", "metric")
    step = both.withColumn("_k", F.count("*").over(family)).withColumn("_i", F.row_number().over(order))
    adjusted = F.max(F.least(F.lit(1.0), (F.col("_k") - F.col("_i") + 1) * F.col("p"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    secondary = checkpointed(step.withColumn("adjusted", adjusted).withColumn("rejects", F.col("adjusted") <= plan.alpha).drop("_k", "_i"))

    wins = secondary.groupBy("by").agg(F.max(F.col("rejects") & F.col("improves")).alias("_wins"))
    holds = primary.groupBy("by").agg(F.min("non_inferior").alias("_holds"))
    told = state.join(holds, "by", "left").join(wins, "by", "left")
    success = F.when(F.col("status") == "ok", F.col("_holds") & F.coalesce("_wins", F.lit(False)))
    used = F.when(F.col("status") == "ok", F.col("pairs"))
    return Analysis(told.select("by", "status", "keys", "shared", used.alias("pairs"), success.alias("success")), refusals, primary, secondary)
