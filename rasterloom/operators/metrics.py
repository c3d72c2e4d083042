"""Error metrics between samples that are joined by place, and decisions on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_metrics(df: DataFrame, actual: str, expected: str, *keys: str) -> DataFrame:
    """total, exact, max_abs and the exact sum of squares for each group; one pass with partial sums."""
    d = F.col(actual) - F.col(expected)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum((d == 0).cast("bigint")).alias("exact"), F.max(F.abs(d)).alias("max_abs"), F.sum((d * d).cast("decimal(38,0)")).alias("squares"))


def histogram(df: DataFrame, actual: str, expected: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.abs(F.col(actual) - F.col(expected)).alias("abs_error")).agg(F.count("*").alias("n"))


def exact_rate(exact: Column, total: Column) -> Column:
    """1 where there is nothing to compare."""
    return F.when(total > 0, exact / total).otherwise(1.0)


def classify(max_abs: Column, rate: Column, least: float = 0.999) -> Column:
    return F.when(max_abs == 0, "exact").when((max_abs <= 1) & (rate >= least), "one_lsb").otherwise("outside")


def psnr(squares: Column, total: Column, peak) -> Column:
    """In dB; null where nothing differs."""
    mse = squares.cast("double") / total
    return F.when(mse > 0, 10.0 * F.log10(F.lit(float(peak)) * float(peak) / mse))


def quality_failures(db: Column, least_db, rate: Column, most_rate) -> Column:
    """Names of the limits that are missed; a null figure of dB is infinite."""
    return F.filter(F.array(F.when(db < least_db, "psnr"), F.when(rate > most_rate, "rate")), lambda x: x.isNotNull())


def perf_regressions(baseline: DataFrame, current: DataFrame, threshold_percent: float = 10.0, least_ns: float = 100.0) -> DataFrame:
    """Benchmarks whose confidence intervals are apart by more than the threshold; ids of one side only are named missing."""
    b, c = (d.select("id", *(F.col(n).alias(f"{s}_{n}") for n in ("median", "lower", "upper"))) for d, s in ((baseline, "base"), (current, "now")))
    j = b.join(c, "id", "full_outer")
    apart = F.col("now_lower") - F.col("base_upper")
    return j.select(
        "id", F.when(F.col("now_median").isNull(), "missing_current").when(F.col("base_median").isNull(), "missing_baseline").when(F.col("base_median") <= 0, "bad_baseline").otherwise("compared").alias("state"),
        F.round((F.col("now_median") - F.col("base_median")) / F.nullif(F.col("base_median"), F.lit(0.0)) * 100.0, 6).alias("delta_percent"),
        F.coalesce((apart / F.nullif(F.col("base_upper"), F.lit(0.0)) * 100.0 > threshold_percent) & (apart > least_ns), F.lit(False)).alias("regressed"))


def qualifying_wins(hybrid: DataFrame, competitor: DataFrame) -> DataFrame:
    """A route wins if its median is at most 0.9 of the other's, and its interval lies below."""
    j = hybrid.select("id", *(F.col(n).alias(f"h_{n}") for n in ("median", "lower", "upper"))).join(competitor.select("id", *(F.col(n).alias(f"c_{n}") for n in ("median", "lower", "upper"))), "id")
    return j.select("id", ((F.col("h_median") <= 0.9 * F.col("c_median")) & (F.col("h_upper") < F.col("c_lower"))).alias("wins"), F.round((F.col("c_median") - F.col("h_median")) / F.col("c_median") * 100.0, 6).alias("speedup_percent"))
