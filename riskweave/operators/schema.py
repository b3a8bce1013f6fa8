"""Standardising transaction tables, splitting them by time, cleaning columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.config import ColumnRoles
from riskweave.functions.scalar import clean

#: Columns forced to strings; null stays null, so that missing ids never meet.
IDS = ("transaction_id", "account_id", "counterparty_account_id", "device_id", "ip_address", "phone", "email")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "MM/dd/yyyy")


class Splits(NamedTuple):
    train: DataFrame
    validation: DataFrame
    test: DataFrame


def instant(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; null where it can't be read."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(name).cast("timestamp")
    text = F.col(name).cast("string")
    return F.coalesce(F.expr(f"try_cast(`{name}` AS timestamp)") if isinstance(kind, T.StringType) else F.lit(None).cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])


def number(df: DataFrame, name: str) -> Column:
    """The column as a double; null where it can't be read or isn't a number."""
    c = F.expr(f"try_cast(`{name}` AS double)")
    return F.when(~F.isnan(c), c)


def standardize(df: DataFrame, roles: ColumnRoles = ColumnRoles(), check: bool = True) -> DataFrame:
    """Typed columns. Timestamp and amount must exist; timestamps that can't be read raise an error.

    Amounts that can't be read are 0, labels 0, balances and creation times null. A missing
    label column is added as 0. check=False leaves out the pass that counts bad timestamps.
    """
    for needed in (roles.timestamp, "amount"):
        if needed not in df.columns:
            raise ValueError(f"a transaction table needs the column {needed}")
    out = df.withColumn(roles.timestamp, instant(df, roles.timestamp))
    if check and (bad := out.agg(F.count_if(F.col(roles.timestamp).isNull())).first()[0]):
        raise ValueError(f"{bad} timestamps can't be read")
    out = out.withColumn("amount", F.coalesce(number(df, "amount"), F.lit(0.0)))
    label = F.coalesce(number(df, roles.label), F.lit(0.0)).cast("int") if roles.label in df.columns else F.lit(0)
    out = out.withColumn(roles.label, label)
    if "account_created_at" in df.columns:
        out = out.withColumn("account_created_at", instant(df, "account_created_at"))
    if "balance" in df.columns:
        out = out.withColumn("balance", number(df, "balance"))
    ids = {*IDS, roles.transaction_id, roles.account_id, roles.counterparty_account_id}
    return out.withColumns({c: F.col(c).cast("string") for c in df.columns if c in ids})


def temporal_split(df: DataFrame, train_end: str, validation_end: str, ts: str = "timestamp", check: bool = True) -> Splits:
    """Rows up to train_end, up to validation_end, and later; a date means its midnight."""
    a, b = F.lit(train_end).cast("timestamp"), F.lit(validation_end).cast("timestamp")
    if not train_end < validation_end:
        raise ValueError("validation_end must be after train_end")
    t = F.col(ts)
    if check:
        found = df.agg(F.count_if(t <= a), F.count_if((t > a) & (t <= b)), F.count_if(t > b)).first()
        if not all(found):
            raise ValueError(f"a split is empty: {tuple(found)}")
    return Splits(df.filter(t <= a), df.filter((t > a) & (t <= b)), df.filter(t > b))


def with_defaults(df: DataFrame) -> DataFrame:
    """Adds the optional categoricals, and fills them, with "unknown"."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in df.columns else F.lit("unknown") for c in ("merchant_category", "channel")})


def cleaned(df: DataFrame, keep: tuple[str, ...] = IDS) -> DataFrame:
    """Numbers without null, NaN and infinities (0 instead), other strings without null ("unknown")."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = clean(F.col(f.name))
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType) and f.name not in keep:
            out[f.name] = F.coalesce(F.col(f.name), F.lit("unknown"))
    return df.withColumns(out)
