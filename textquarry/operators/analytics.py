"""Analytics of query logs: summaries, series, percentiles, windows, experiments, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.session import cut_lineage, shuffle_width


def summary(log: DataFrame, by: str) -> DataFrame:
    """Counts and means of value for each ``by``."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("user_id").alias("users"),
        F.round(F.avg("value"), 6).alias("mean_value"),
        F.round(F.coalesce(F.stddev_pop("value"), F.lit(0.0)), 6).alias("std_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def totals(log: DataFrame, error: str = "error") -> DataFrame:
    """One row: all, errors, error rate, and counts and sums of the last hour and day before the latest event."""
    end = log.agg(F.max("ts").alias("end"))
    x = log.join(F.broadcast(end))
    hour, day = F.col("ts") > F.col("end") - F.expr("INTERVAL 1 HOUR"), F.col("ts") > F.col("end") - F.expr("INTERVAL 1 DAY")
    return x.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == error).alias("errors"),
        F.round(F.try_divide(F.count_if(F.col("event_type") == error), F.count(F.lit(1))), 6).alias("error_rate"),
        F.count_if(hour).alias("last_hour"),
        F.count_if(day).alias("last_day"),
        F.round(F.coalesce(F.sum(F.when(day, F.col("value"))), F.lit(0.0)), 4).alias("value_last_day"),
    )


def hourly_series(log: DataFrame) -> DataFrame:
    """(hour, n, mean_value): every hour from the first to the last, those without events with 0."""
    per = log.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    ends = log.agg(F.date_trunc("hour", F.min("ts")).alias("a"), F.date_trunc("hour", F.max("ts")).alias("b")).where(F.col("a").isNotNull())
    hours = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return hours.join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_value"))


def histogram(log: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(bin, label, n) of values from 0 to 1; 1 falls into the last bin."""
    width = 100 // bins
    b = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("int")
    counted = log.where(value.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    label = F.concat((F.col("bin") * width).cast("string"), F.lit("-"), ((F.col("bin") + 1) * width).cast("string"), F.lit("%"))
    return counted.select("bin", label.alias("label"), "n")


def percentiles(log: DataFrame, by: str, shares: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at index min(int(n * p), n - 1) of the sorted values of each ``by``.

    Equal values are counted first; the different ones are laid out by range, and counts are summed within
    each range and over the few ranges, so that no task needs all values of one ``by``. Nulls have no rank.
    """
    spark = log.sparkSession
    counted = log.where(F.col("value").isNotNull()).groupBy(F.col(by).alias("k"), "value").agg(F.count(F.lit(1)).alias("c"))
    laid = cut_lineage(counted.repartitionByRange(shuffle_width(spark), "k", "value").withColumn("part", F.spark_partition_id()))
    over = Window.partitionBy("k").orderBy("part")
    ranges = laid.groupBy("k", "part").agg(F.sum("c").alias("c"))
    ranges = ranges.select(F.col("k").alias("k2"), F.col("part").alias("part2"), (F.sum("c").over(over) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("k")).alias("n"))
    within = F.sum("c").over(Window.partitionBy("k", "part").orderBy("value"))
    ranked = laid.withColumn("upto", within).join(ranges, F.col("k").eqNullSafe(F.col("k2")) & (F.col("part") == F.col("part2")))
    index = lambda p: F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    picks = [F.min(F.when(F.col("before") + F.col("upto") > index(p), F.col("value"))).alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy(F.col("k").alias(by)).agg(*picks)


def most_frequent(log: DataFrame, by: str, k: int = 10) -> DataFrame:
    return log.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(k)


def variant_of(user: Column, split: Sequence[float]) -> Column:
    """Number of the variant: md5(user) modulo 100 against the running sum of the split (in percent).

    2**32 is 96 modulo 100, so the four words of the hash fold by Horner's rule.
    """
    h = F.md5(user.cast("string"))
    bucket = F.lit(0).cast("bigint")
    for at in (1, 9, 17, 25):
        bucket = (bucket * 96 + F.conv(F.substring(h, at, 8), 16, 10).cast("bigint")) % 100
    out, edge = F.lit(len(split) - 1), 100.0
    for k in range(len(split) - 1, -1, -1):
        edge = sum(split[: k + 1])
        out = F.when(bucket < edge, k).otherwise(out)
    return out.cast("int")


def variant_metrics(log: DataFrame, split: Sequence[float] = (50, 50), error: str = "error") -> DataFrame:
    """(variant, n, users, mean_value, std_value, error_rate); the deviation is of the sample, 0 under two rows."""
    return (
        log.withColumn("variant", variant_of(F.col("user_id"), split))
        .groupBy("variant")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("user_id").alias("users"),
            F.round(F.avg("value"), 6).alias("mean_value"),
            F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std_value"),
            F.round(F.count_if(F.col("event_type") == error) / F.count(F.lit(1)), 6).alias("error_rate"),
        )
    )


def experiment_report(metrics: DataFrame, least: int = 100) -> DataFrame:
    """(winner, gap, confidence): the best mean against the second; 0 confidence under ``least`` rows each."""
    w = Window.orderBy(F.desc("mean_value"), "variant")
    ranked = metrics.withColumn("r", F.row_number().over(w))
    x = ranked.agg(
        F.max(F.when(F.col("r") == 1, F.col("variant"))).alias("winner"),
        F.round(F.max(F.when(F.col("r") == 1, F.col("mean_value"))) - F.max(F.when(F.col("r") == 2, F.col("mean_value"))), 6).alias("gap"),
        F.min("n").alias("n"),
    )
    sure = F.when(F.col("n") < least, 0.0).otherwise((F.least(F.col("n") / least, F.lit(1.0)) + F.least(5 * F.abs("gap"), F.lit(1.0))) / 2)
    return x.select("winner", "gap", F.round(sure, 6).alias("confidence"))


def trailing_counts(log: DataFrame, key: str = "user_id", seconds: int = 60) -> DataFrame:
    """(event_id, in_window): events of the same key in the trailing seconds, the event included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return log.where(F.col("ts").isNotNull()).select("event_id", F.count(F.lit(1)).over(w).alias("in_window"))


def budget_levels(log: DataFrame, daily: float) -> DataFrame:
    """(day, spent, level): 0 up to 80 % of the daily budget, 1 up to it, 2 beyond."""
    per = log.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("spent"))
    return per.select("day", "spent", F.when(F.col("spent") > daily, 2).when(F.col("spent") >= 0.8 * daily, 1).otherwise(0).alias("level"))


def running_spend(log: DataFrame) -> DataFrame:
    """(event_id, spent_today): the running sum of a user's values within the day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("event_id", F.round(F.sum("value").over(w), 4).alias("spent_today"))


def sessions(log: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session, n, started, ended): a gap of more than ``gap_minutes`` begins a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)) > gap_minutes * 60_000_000
    marked = log.withColumn("session", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def tumbling(log: DataFrame, minutes: int = 15) -> DataFrame:
    """(window_start, event_type, n, value): works on batches and, with a watermark, on streams."""
    per = log.groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return per.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")


def token_cost(tokens_in: Column, tokens_out: Column, model: Column, rates: dict[str, tuple[float, float]]) -> Column:
    """Cost at a rate per thousand tokens in and out; unknown models cost nothing."""
    if not rates:
        return F.lit(0.0)
    out = F.lit(0.0)
    for name, (a, b) in rates.items():
        out = F.when(model == name, tokens_in / 1000 * a + tokens_out / 1000 * b).otherwise(out)
    return F.round(out, 6)


def score_aggregate(scores: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, std, min, max, n) with the deviation of the population."""
    return scores.where(F.col(value).isNotNull()).groupBy(by).agg(
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_pop(value), 6).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.count(F.lit(1)).alias("n"),
    )


def regressions(now: DataFrame, baseline: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, now, before, verdict) of metrics (metric, value) in both: regression, improvement or same."""
    both = now.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("before")), "metric")
    delta = F.col("now") - F.col("before")
    return both.withColumn("verdict", F.when(delta < -tolerance, "regression").when(delta > tolerance, "improvement").otherwise("same"))


def step_confidence(steps: DataFrame) -> DataFrame:
    """(question_id, confidence) of reasoning steps (question_id, step, confidence): later steps weigh more."""
    return steps.groupBy("question_id").agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("step") * F.col("confidence")), F.sum("step")), F.lit(0.0)), 6).alias("confidence"))


def audit_report(audit: DataFrame) -> DataFrame:
    """(user, requests, denied, denial_rate) of access decisions (user, allowed)."""
    return audit.groupBy("user").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("allowed")).alias("denied"), F.round(F.count_if(~F.col("allowed")) / F.count(F.lit(1)), 6).alias("denial_rate")
    )


def laplace_noise(value: Column, key: Column, sensitivity: float = 1.0, epsilon: float = 1.0) -> Column:
    """Value with Laplace noise of scale sensitivity / epsilon, the same for the same key."""
    u = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1_000_003)) / 1_000_003.0 - 0.4999995
    return value - F.lit(sensitivity / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
