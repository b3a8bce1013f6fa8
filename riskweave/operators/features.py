"""Per-account behaviour features over trailing time frames.

All frames share one partitioning and one sort; a busy account is cut into stretches of time. A frame of W ends at the row and leaves out
what is exactly W old. Rows of one instant see each other; the tie-exact forms see only the
earlier ones of them by the tie-break column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles
from riskweave.functions.scalar import MICROS, days_between, is_weekend, safe_div
from riskweave.operators.schema import cleaned, with_defaults
from riskweave.sources.scratch import written

#: An account of more rows has its timeline cut into stretches.
BUSY_ROWS = 1_000_000
#: Most busy accounts that are broadcast; there is one for BUSY_ROWS rows at most.
BROADCAST_ROWS = 100_000
#: The stretch of rows without a time.
TIMELESS = -(1 << 40)

NUMERIC = (
    "amount", "amount_over_median_30d", "amount_over_avg_balance", "hour", "is_weekend", "device_score", "count_tx_last_1h", "count_tx_last_24h", "count_tx_last_7d",
    "transactions_count_lifetime", "account_age_days", "avg_amt_1d", "std_amt_7d", "pct_change_avg_amt_30d", "ratio_large_tx_count",
)
CATEGORICAL = ("merchant_category", "channel")


def micros(ts: str = "timestamp") -> Column:
    return F.unix_micros(ts)


def frame(window: str, account: str = "account_id", ts: str = "timestamp") -> WindowSpec:
    """The trailing frame (t - window, t]."""
    return Window.partitionBy(account).orderBy(micros(ts)).rangeBetween(-(MICROS[window] - 1), 0)


def ordered(account: str = "account_id", ts: str = "timestamp", tie: str = "transaction_id") -> WindowSpec:
    return Window.partitionBy(account).orderBy(micros(ts), tie)


def fit_threshold(train: DataFrame, level: float = 0.95) -> float:
    """The amount that counts as large: an exact quantile in bounded memory."""
    return exact_quantiles(train, "amount", [level])[0] or 0.0


def build_features(df: DataFrame, threshold: float, account: str = "account_id", ts: str = "timestamp", tie: str = "transaction_id", busy: int = BUSY_ROWS) -> DataFrame:
    """All tabular features of a standardised table.

    Accounts of more than `busy` rows have their timeline cut into stretches, each a task's
    group of its own, and carry what a stretch needs of those before it; the values are the same.
    """
    t = F.col(ts)
    out = df.withColumns({"hour": F.hour(t), "is_weekend": is_weekend(t), "__large": (F.col("amount") > threshold).cast("int")})
    busy_ones = _busy(df, account, busy)
    if busy_ones is None:
        out = _running(_trailing(out, [account], ts), [account], ts, tie)
    else:
        of = lambda rows, how: rows.join(busy_ones, rows[account].eqNullSafe(F.col("__busy")), how)
        plain = _running(_trailing(of(out, "left_anti"), [account], ts), [account], ts, tie)
        out = plain.unionByName(_carried(of(out, "left_semi"), account, ts, tie))
    out = out.withColumns({
        "avg_balance": F.coalesce(F.col("__sum") / F.col("__n"), F.lit(0.0)) if "balance" in df.columns else F.col("avg_amt_30d"),
        "account_age_days": days_between(t, F.col("account_created_at") if "account_created_at" in df.columns else F.col("__seen")),
    })
    amount = F.col("amount")
    out = out.withColumns({
        "pct_change_avg_amt_30d": safe_div(F.col("avg_amt_30d") - F.col("__before"), F.col("__before")),
        "amount_over_median_30d": safe_div(amount, F.col("median_amount_30d")),
        "amount_over_avg_balance": safe_div(amount, F.col("avg_balance")),
        "ratio_large_tx_count": safe_div(F.col("large_tx_count_30d"), F.col("tx_count_30d")),
    }).drop("__large", "__before", "__seen", "__funds", "__sum", "__n")
    return cleaned(with_defaults(device_score(out, account)))


def _busy(df: DataFrame, account: str, busy: int) -> DataFrame | None:
    """The accounts of more than `busy` rows as __busy, broadcast where they are few; None if there are none."""
    found = written(df.groupBy(F.col(account).alias("__busy")).count().filter(F.col("count") > busy).select("__busy"))
    n = found.count()
    return None if not n else F.broadcast(found) if n <= BROADCAST_ROWS else found


def _trailing(df: DataFrame, by: list[str], ts: str) -> DataFrame:
    """df with the aggregates of the trailing frames."""
    day, week, month, hour_ = (Window.partitionBy(*by).orderBy(micros(ts)).rangeBetween(-(MICROS[w] - 1), 0) for w in ("1D", "7D", "30D", "1h"))
    return df.withColumns({
        "median_amount_30d": F.percentile("amount", F.lit(0.5)).over(month),
        "avg_amt_1d": F.avg("amount").over(day),
        "std_amt_7d": F.coalesce(F.stddev_samp("amount").over(week), F.lit(0.0)),
        "avg_amt_30d": F.avg("amount").over(month),
        "count_tx_last_1h": F.count("amount").over(hour_).cast("double"),
        "count_tx_last_24h": F.count("amount").over(day).cast("double"),
        "count_tx_last_7d": F.count("amount").over(week).cast("double"),
        "large_tx_count_30d": F.sum("__large").over(month).cast("double"),
        "tx_count_30d": F.count("amount").over(month).cast("double"),
    })


def _running(df: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """df with what depends on all rows before: the row's number, first instant, average before, known balances."""
    line = Window.partitionBy(*by).orderBy(micros(ts), tie)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({
        "transactions_count_lifetime": F.row_number().over(line).cast("long"),
        "__seen": F.min(ts).over(Window.partitionBy(*by)),
        "__before": F.lag("avg_amt_30d").over(line),
        **({"__funds": F.last("balance", ignorenulls=True).over(so_far)} if "balance" in df.columns else {}),
    })
    return out.withColumns({"__sum": F.sum("__funds").over(so_far), "__n": F.count("__funds").over(so_far)}) if "balance" in df.columns else out


def _carried(df: DataFrame, account: str, ts: str, tie: str) -> DataFrame:
    """_trailing and _running of busy accounts, by stretches of the longest frame.

    A stretch also holds the one before it as a halo, which is all its frames see. What depends
    on the whole past is summed up by stretch: an account has as many rows there as months.
    """
    part = [account, "__part"]
    out = written(_running(_trailing(_with_halo(df, "30D", ts), part, ts).filter("__part = __own"), part, ts, tie).drop("__own"))
    last = lambda c: F.max_by(c, F.struct(micros(ts), tie))
    funds = "balance" in df.columns
    told = out.groupBy(*part).agg(
        F.count("*").alias("rows"), F.min(ts).alias("first"), last("avg_amt_30d").alias("avg"),
        *([last("__funds").alias("funds"), F.count_if(F.col("__funds").isNull()).alias("lead"), last("__sum").alias("sum"), last("__n").alias("n")] if funds else []),
    )
    line = Window.partitionBy(account).orderBy("__part")
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    told = told.withColumns({"c_rows": zero(F.sum("rows").over(past)), "c_seen": F.min("first").over(Window.partitionBy(account)), "c_avg": F.lag("avg").over(line)})
    if funds:  # rows ahead of a stretch's first balance have the last one known before it
        told = told.withColumn("c_funds", F.last("funds", ignorenulls=True).over(past))
        held = F.when(F.col("c_funds").isNotNull(), F.col("lead")).otherwise(0)
        told = told.withColumns({"c_sum": zero(F.sum(zero(F.col("sum")) + zero(F.col("c_funds")) * held).over(past)), "c_n": zero(F.sum(F.col("n") + held).over(past))})
    told = told.select(F.col(account).alias("c_account"), F.col("__part").alias("c_part"), *[c for c in told.columns if c.startswith("c_")], *(["lead"] if funds else []))
    told = told.toDF(*["__" + c for c in told.columns])
    met = out.join(told, out[account].eqNullSafe(told["__c_account"]) & (out["__part"] == told["__c_part"]))
    nth = F.col("transactions_count_lifetime")
    more = {"transactions_count_lifetime": nth + F.col("__c_rows"), "__seen": F.col("__c_seen"), "__before": F.when(nth == 1, F.col("__c_avg")).otherwise(F.col("__before"))}
    if funds:
        held = F.when(F.col("__c_funds").isNotNull(), F.least(nth, F.col("__lead"))).otherwise(0)
        n = F.col("__n") + F.col("__c_n") + held
        total = zero(F.col("__sum")) + F.col("__c_sum") + zero(F.col("__c_funds")) * held
        more |= {"__sum": F.when(n > 0, total), "__n": n}
    return met.withColumns(more).drop("__part", *told.columns)


def _with_halo(df: DataFrame, window: str, ts: str) -> DataFrame:
    """df's rows with the stretch __own of one window length they are in, once as __part and once for the stretch after it.

    Rows without a time are a stretch ahead of all.
    """
    own = F.coalesce(F.floor(micros(ts) / F.lit(MICROS[window])).cast("long"), F.lit(TIMELESS))
    return df.withColumn("__own", own).withColumn("__part", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))


def device_score(df: DataFrame, account: str = "account_id") -> DataFrame:
    """1 over the number of accounts seen on the row's device; 0 without a device, 1 without the column."""
    if "device_id" not in df.columns:
        return df.withColumn("device_score", F.lit(1.0))
    shared = df.filter(F.col("device_id").isNotNull()).groupBy("device_id").agg(F.countDistinct(account).alias("__accounts"))
    return df.join(shared, "device_id", "left").withColumn("device_score", safe_div(F.lit(1.0), F.col("__accounts"))).drop("__accounts")


def tie_exact(df: DataFrame, window: str, account: str = "account_id", ts: str = "timestamp", tie: str = "transaction_id") -> DataFrame:
    """df with tie_count, tie_sum and tie_avg of the amounts in the frame, without later rows of the same instant."""
    w, later = frame(window, account, ts), Window.partitionBy(account, micros(ts)).orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    n = F.count("amount").over(w) - F.count("amount").over(later)
    s = F.sum("amount").over(w) - F.coalesce(F.sum("amount").over(later), F.lit(0.0))
    return df.withColumns({"tie_count": n, "tie_sum": s}).withColumn("tie_avg", safe_div(F.col("tie_sum"), F.col("tie_count")))


def tie_exact_median(df: DataFrame, window: str, account: str = "account_id", ts: str = "timestamp", tie: str = "transaction_id") -> DataFrame:
    """df with tie_median: the median over the tie-exact frame, null amounts left out.

    The last row of an instant sees its whole frame. Only rows with later ones at their instant
    meet their frame's rows by a join on account and stretch; no frame is held in a row.
    """
    size = MICROS[window]
    after = Window.partitionBy(account, micros(ts)).orderBy(tie).rowsBetween(1, Window.unboundedFollowing)
    out = df.withColumns({"__later": F.count(F.lit(1)).over(after) > 0, "__median": F.percentile("amount", F.lit(0.5)).over(frame(window, account, ts))})
    at = [F.col(account).alias("__a"), micros(ts).alias("__t"), F.col(tie).alias("__k")]
    early = out.filter("__later").select(*at, F.floor(micros(ts) / F.lit(size)).alias("__part")).distinct()
    seen = _with_halo(df.select(account, ts, tie, "amount"), window, ts).select(F.col(account).alias("a"), micros(ts).alias("t"), F.col(tie).alias("k"), "amount", F.col("__part").alias("part"))
    before = (F.col("t") < F.col("__t")) | ((F.col("t") == F.col("__t")) & (F.col("k") <= F.col("__k")))
    met = early.join(seen, F.col("__a").eqNullSafe(F.col("a")) & (F.col("__part") == F.col("part")) & (F.col("t") > F.col("__t") - size) & before)
    met = met.groupBy("__a", "__t", "__k").agg(F.percentile("amount", F.lit(0.5)).alias("__exact"))
    same = F.col(account).eqNullSafe(F.col("__a")) & (micros(ts) == F.col("__t")) & (F.col(tie) == F.col("__k"))
    out = out.join(met, same, "left").withColumn("tie_median", F.when(F.col("__later"), F.col("__exact")).otherwise(F.col("__median")))
    return out.drop("__later", "__median", "__a", "__t", "__k", "__exact")


def split_timeline(df: DataFrame, window: str, values: dict[str, Column | None], account: str = "account_id", ts: str = "timestamp") -> DataFrame:
    """Trailing aggregates with an account's timeline cut into stretches, so that one account isn't one task.

    Rows also go, as a halo, to the stretch after their own; a stretch of one window length
    thus holds all that its rows' frames see. values: name to an aggregate expression.
    """
    w = Window.partitionBy(account, "__part").orderBy(micros(ts)).rangeBetween(-(MICROS[window] - 1), 0)
    return _with_halo(df, window, ts).withColumns({n: e.over(w) for n, e in values.items()}).filter("__part = __own").drop("__own", "__part")


def features_with_history(history: DataFrame, target: DataFrame, threshold: float, **names: str | int) -> DataFrame:
    """Features of the target rows, computed with the history before them."""
    both = history.withColumn("__target", F.lit(0)).unionByName(target.withColumn("__target", F.lit(1)), allowMissingColumns=True)
    return build_features(both, threshold, **names).filter("__target = 1").drop("__target")
