"""Stress transformations of transactions, and the incentive experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles

CROSS = "(?i)international|wire|cross"


def concept_drift(df: DataFrame, multiplier: float = 1.3, boost: float = 2.0, channel: str = "channel", cross_border: str = "cross_border", seed: int = 42) -> DataFrame:
    """Larger amounts. With a cross_border column its rows gain 10 % with probability boost - 1; else channels that cross borders are multiplied by boost."""
    amount = F.col("amount") * multiplier
    if cross_border in df.columns:
        amount = F.when((F.col(cross_border) == 1) & (F.rand(seed) < boost - 1), amount * 1.1).otherwise(amount)
    elif channel in df.columns:
        amount = F.when(F.col(channel).rlike(CROSS), amount * boost).otherwise(amount)
    return df.withColumn("amount", amount)


def mimicry(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """Fraud amounts drawn from the legitimate mean and deviation, at least 1; hours, if there, from the legitimate hours.

    Unchanged if either class is empty.
    """
    if label not in df.columns:
        return df
    legit = F.when(F.col(label) == 0, F.col("amount"))
    stats = df.agg(F.avg(legit).alias("__mean"), F.greatest(F.stddev_samp(legit), F.lit(1e-6)).alias("__std"), F.count_if(F.col(label) == 1).alias("__bad"), F.count_if(F.col(label) == 0).alias("__good"))
    both = (F.col("__bad") > 0) & (F.col("__good") > 0)
    drawn = F.greatest(F.col("__mean") + F.coalesce("__std", F.lit(1e-6)) * F.randn(seed), F.lit(1.0))
    out = df.crossJoin(F.broadcast(stats)).withColumn("amount", F.when(both & (F.col(label) == 1), drawn).otherwise(F.col("amount")))
    if "hour" in df.columns:
        hours = df.filter(F.col(label) == 0).groupBy(F.col("hour").alias("__hour")).count()
        run = Window.orderBy("__hour")  # at most 24 rows
        hours = hours.withColumn("__to", F.sum("count").over(run) / F.sum("count").over(Window.partitionBy()))
        table = hours.agg(F.array_sort(F.collect_list(F.struct("__to", "__hour"))).alias("__table"))
        out = out.withColumn("__u", F.rand(seed + 1)).crossJoin(F.broadcast(table))
        pick = F.element_at(F.filter("__table", lambda h: h["__to"] >= F.col("__u") - 1e-12), 1)["__hour"]
        out = out.withColumn("hour", F.when(both & (F.col(label) == 1), pick).otherwise(F.col("hour"))).drop("__u", "__table")
    return out.drop("__mean", "__std", "__bad", "__good")


def splitting(df: DataFrame, factor: int = 4, level: float = 0.99, label: str = "label") -> DataFrame:
    """Fraud at or above the amount's quantile becomes `factor` rows of equal parts with numbered ids."""
    if factor < 2 or "amount" not in df.columns or label not in df.columns:
        return df
    bound = exact_quantiles(df, "amount", [level])[0]
    if bound is None:
        return df
    split = (F.col(label) == 1) & (F.col("amount") >= bound)
    parts = df.withColumn("__part", F.explode(F.when(split, F.sequence(F.lit(1), F.lit(factor))).otherwise(F.array(F.lit(0)))))
    out = parts.withColumn("amount", F.when(F.col("__part") > 0, F.col("amount") / factor).otherwise(F.col("amount")))
    if "transaction_id" in df.columns:
        out = out.withColumn("transaction_id", F.when(F.col("__part") > 0, F.concat("transaction_id", F.lit("_split_"), F.col("__part").cast("string"))).otherwise(F.col("transaction_id")))
    return out.drop("__part")


def ab_test(scored: DataFrame, label: str = "label", bands: str = "risk_band", key: str = "transaction_id", seed: int = 42) -> DataFrame:
    """One row: fraud and dropout rates of control and treatment among medium rows, and their differences.

    Rows are assigned by the first digit of the MD5 of their key and the seed; null keys are the control. Of the treated fraud a quarter is blocked and of
    the treated rows 3 in 100 drop out, the first in another hash's order.
    """
    medium = scored.filter(F.col(bands) == "medium")
    if "final_score" in scored.columns and medium.isEmpty():
        lo, hi = exact_quantiles(scored, "final_score", [0.4, 0.8])
        medium = scored.filter(F.col("final_score").between(lo, hi)) if lo is not None else medium
    rows = medium.select(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 1).isin(*"13579bdf").alias("treated"), (F.col(label) == 1).cast("int").alias("fraud"))
    # which rows are blocked or drop out doesn't change a mean, so their numbers are enough
    n = rows.groupBy("treated").agg(F.count("*").alias("n"), F.sum("fraud").alias("bad"))
    one = n.agg(*[F.coalesce(F.sum(F.when(F.coalesce("treated", F.lit(False)) == t, F.col(c))), F.lit(0)).alias(f"{c}_{w}") for t, w in ((False, "c"), (True, "t")) for c in ("n", "bad")])
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = one.select(
        rate(F.col("bad_c"), F.col("n_c")).alias("control_fraud_rate"), rate(F.col("bad_t") - F.floor(F.col("bad_t") * 0.25), F.col("n_t")).alias("treatment_fraud_rate"),
        F.lit(0.0).alias("control_dropout"), rate(F.floor(F.col("n_t") * 0.03), F.col("n_t")).alias("treatment_dropout"),
    )
    return out.withColumns({"effect_fraud_rate": F.col("treatment_fraud_rate") - F.col("control_fraud_rate"), "effect_dropout": F.col("treatment_dropout") - F.col("control_dropout")})
