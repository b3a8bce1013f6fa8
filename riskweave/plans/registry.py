"""Every named query of the risk engine with its SQL equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.config import RiskConfig
from riskweave.functions.scalar import band
from riskweave.operators import features, graph, models, payload, risk, simulate
from riskweave.operators.schema import standardize, temporal_split
from riskweave.plans.adapters import EVENTS_SQL, ORDERS_SQL, SCORED_SQL, events, orders, scored_events
from riskweave.plans.engine import Engine
from riskweave.sources import readers, sinks
from riskweave.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TRAIN_END, VALIDATION_END = "2024-01-18", "2024-01-24"
LOW, HIGH = 0.3, 0.6
C = RiskConfig()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES


def rounded(c, name: str):
    return F.round(c, 9).alias(name)


def shown(df: DataFrame, *names: str, key: str = "transaction_id") -> DataFrame:
    """The key and rounded columns."""
    return df.select(key, *[rounded(F.col(n).cast("double"), n) for n in names])


# Scans, schema, splits


@query("""
    WITH raw AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 3 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS amount, ts FROM events)
    SELECT CAST(event_id AS VARCHAR) AS transaction_id, 'U' || user_id AS account_id, date_trunc('second', ts)::VARCHAR AS at, round(coalesce(TRY_CAST(amount AS DOUBLE), 0), 9) AS amount, 0 AS label,
           CASE WHEN event_id % 5 = 1 THEN NULL ELSE round(event_id / 2.0, 9)::DOUBLE END AS balance FROM raw""")
def standardize_schema(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    raw = e.select(
        F.col("event_id").alias("transaction_id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("account_id"), text.alias("timestamp"),
        F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string")).alias("amount"), F.when(F.col("event_id") % 5 == 1, "none").otherwise((F.col("event_id") / 2.0).cast("string")).alias("balance"),
    )
    return standardize(raw).select("transaction_id", "account_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), rounded(F.col("amount"), "amount"), "label", rounded(F.col("balance"), "balance"))


@query(f"""
    WITH {EVENTS_SQL}
    SELECT CASE WHEN timestamp <= TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN timestamp <= TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split, count(*) AS n, round(sum(amount), 4) AS total FROM tx GROUP BY 1""")
def temporal_split_counts(spark, sf):
    parts = temporal_split(events(spark, sf), TRAIN_END, VALIDATION_END)._asdict()
    counted = [d.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total")).select(F.lit(n).alias("split"), "n", "total") for n, d in parts.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("""
    SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15""")
def report_preview(spark, sf):
    """The preview is a top-15 report: its limit is the feature."""
    df = spark.read.parquet(f"{sf}/orders.parquet").withColumn("by", -F.col("o_totalprice"))
    return readers.preview(df, ["by", "o_orderkey"], 15).select("o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query()
def generated_transactions(spark, sf):
    return readers.generate(spark, 20_000).groupBy("label", "channel").agg(F.count("*").alias("n"), F.avg("amount").alias("mean_amount"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 9) END AS v, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS was_odd FROM events""")
def sanitized_json(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    odd = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    rows = sinks.json_rows(e.select("event_id", odd.alias("v"), (F.col("event_id") % 3 == 0).cast("int").alias("was_odd")))
    back = rows.select(F.from_json("json", "event_id long, v double, was_odd int").alias("j")).select("j.*")
    return back.select("event_id", rounded(F.col("v"), "v"), "was_odd")


# Trailing windows


def _rolling(expr: str, days: float) -> str:
    width = int(days * 86_400_000_000) - 1
    return f"""
    WITH {EVENTS_SQL}, w AS (SELECT *, epoch_us(timestamp) AS t FROM tx)
    SELECT transaction_id, {expr} FROM w
    WINDOW f AS (PARTITION BY account_id ORDER BY t RANGE BETWEEN {width} PRECEDING AND CURRENT ROW), l AS (PARTITION BY account_id ORDER BY t, transaction_id)"""


def _built(spark, sf, *names):
    return shown(features.build_features(events(spark, sf), 400.0), *names)


@query(_rolling("round(avg(amount) OVER f, 9) AS avg_amt_1d", 1))
def rolling_avg_1d(spark, sf):
    return _built(spark, sf, "avg_amt_1d")


@query(_rolling("round(coalesce(stddev_samp(amount) OVER f, 0), 9) AS std_amt_7d", 7))
def rolling_std_7d(spark, sf):
    return _built(spark, sf, "std_amt_7d")


@query(_rolling("round(avg(amount) OVER f, 9) AS avg_amt_30d", 30))
def rolling_avg_30d(spark, sf):
    return _built(spark, sf, "avg_amt_30d")


@query(_rolling("round(avg(amount) OVER f, 9) AS avg_7d, count(*) OVER f AS n_7d", 7))
def rolling_split_timeline(spark, sf):
    """The same kind of frame with accounts' timelines cut into stretches."""
    out = features.split_timeline(events(spark, sf), "7D", {"avg_7d": F.avg("amount"), "n_7d": F.count("*")})
    return out.select("transaction_id", rounded(F.col("avg_7d"), "avg_7d"), "n_7d")


@query(_rolling("round(quantile_cont(amount, 0.5) OVER f, 9) AS median_amount_30d", 30))
def rolling_median_30d(spark, sf):
    return _built(spark, sf, "median_amount_30d")


@query(_rolling("round(CASE WHEN quantile_cont(amount, 0.5) OVER f = 0 THEN 0 ELSE amount / quantile_cont(amount, 0.5) OVER f END, 9) AS amount_over_median_30d", 30))
def amount_over_median(spark, sf):
    return _built(spark, sf, "amount_over_median_30d")


@query(_rolling("count(*) OVER f::DOUBLE AS count_tx_last_1h".replace("f::DOUBLE", "f"), 1 / 24).replace("count(*) OVER f AS", "(count(*) OVER f)::DOUBLE AS"))
def velocity_1h(spark, sf):
    return _built(spark, sf, "count_tx_last_1h")


@query(_rolling("(count(*) OVER f)::DOUBLE AS count_tx_last_24h", 1))
def velocity_24h(spark, sf):
    return _built(spark, sf, "count_tx_last_24h")


@query(_rolling("(count(*) OVER f)::DOUBLE AS count_tx_last_7d", 7))
def velocity_7d(spark, sf):
    return _built(spark, sf, "count_tx_last_7d")


@query(_rolling("(sum(CASE WHEN amount > 400 THEN 1 ELSE 0 END) OVER f)::DOUBLE AS large_tx_count_30d, (count(*) OVER f)::DOUBLE AS tx_count_30d, round((sum(CASE WHEN amount > 400 THEN 1 ELSE 0 END) OVER f) / (count(*) OVER f), 9) AS ratio_large_tx_count", 30))
def large_tx_ratio_30d(spark, sf):
    return _built(spark, sf, "large_tx_count_30d", "tx_count_30d", "ratio_large_tx_count")


@query(f"""
    WITH {EVENTS_SQL}, w AS (SELECT *, epoch_us(timestamp) AS t FROM tx),
    a AS (SELECT *, avg(amount) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW) AS m FROM w),
    b AS (SELECT *, lag(m) OVER (PARTITION BY account_id ORDER BY t, transaction_id) AS p FROM a)
    SELECT transaction_id, round(CASE WHEN p IS NULL OR p = 0 THEN 0 ELSE (m - p) / p END, 9) AS pct_change_avg_amt_30d FROM b""")
def pct_change_avg_30d(spark, sf):
    return _built(spark, sf, "pct_change_avg_amt_30d")


@query(f"WITH {EVENTS_SQL} SELECT transaction_id, (row_number() OVER (PARTITION BY account_id ORDER BY epoch_us(timestamp), transaction_id))::DOUBLE AS transactions_count_lifetime FROM tx")
def lifetime_count(spark, sf):
    return _built(spark, sf, "transactions_count_lifetime")


@query(f"WITH {EVENTS_SQL} SELECT transaction_id, round((epoch_us(timestamp) - epoch_us(min(timestamp) OVER (PARTITION BY account_id))) / 8.64e10, 9) AS account_age_days FROM tx")
def account_age(spark, sf):
    return _built(spark, sf, "account_age_days")


@query(f"WITH {EVENTS_SQL} SELECT transaction_id, hour(timestamp)::DOUBLE AS hour, CASE WHEN isodow(timestamp) >= 6 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_weekend FROM tx")
def hour_weekend(spark, sf):
    return _built(spark, sf, "hour", "is_weekend")


@query(f"""
    WITH {EVENTS_SQL},
    a AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY epoch_us(timestamp), transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM tx),
    m AS (SELECT *, coalesce(avg(b) OVER (PARTITION BY account_id ORDER BY epoch_us(timestamp), transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS v FROM a)
    SELECT transaction_id, round(v, 9) AS avg_balance, round(CASE WHEN v = 0 THEN 0 ELSE amount / v END, 9) AS amount_over_avg_balance FROM m""")
def avg_balance_ffill(spark, sf):
    return _built(spark, sf, "avg_balance", "amount_over_avg_balance")


_TIES = f"""
    WITH {ORDERS_SQL}, w AS (SELECT *, epoch_us(timestamp) AS t FROM tx),
    m AS (SELECT a.transaction_id, count(*) AS n, sum(b.amount) AS s, quantile_cont(b.amount, 0.5) AS med FROM w a JOIN w b
          ON a.account_id = b.account_id AND b.t > a.t - 2592000000000 AND (b.t < a.t OR (b.t = a.t AND b.transaction_id <= a.transaction_id)) GROUP BY a.transaction_id)
"""


@query(_TIES + "SELECT transaction_id, n AS tie_count, round(s, 4) AS tie_sum, round(s / n, 4) AS tie_avg FROM m")
def tie_exact_velocity(spark, sf):
    out = features.tie_exact(orders(spark, sf), "30D")
    return out.select("transaction_id", "tie_count", F.round("tie_sum", 4).alias("tie_sum"), F.round("tie_avg", 4).alias("tie_avg"))


@query(_TIES + "SELECT transaction_id, round(med, 4) AS tie_median FROM m")
def tie_exact_median(spark, sf):
    return features.tie_exact_median(orders(spark, sf), "30D").select("transaction_id", F.round("tie_median", 4).alias("tie_median"))


@query(f"WITH {EVENTS_SQL}, d AS (SELECT device_id, count(DISTINCT account_id) AS n FROM tx GROUP BY 1) SELECT transaction_id, round(1.0 / n, 9) AS device_score FROM tx JOIN d USING (device_id)")
def device_score(spark, sf):
    return shown(features.device_score(events(spark, sf)), "device_score")


@query(f"WITH {EVENTS_SQL} SELECT round(quantile_cont(amount, 0.95), 9) AS threshold FROM tx WHERE timestamp <= TIMESTAMP '{TRAIN_END}'")
def large_amount_threshold(spark, sf):
    train = temporal_split(events(spark, sf), TRAIN_END, VALIDATION_END).train
    return spark.createDataFrame([(round(features.fit_threshold(train), 9),)], "threshold double")


@query(f"""
    WITH {EVENTS_SQL}, w AS (SELECT *, epoch_us(timestamp) AS t FROM tx WHERE timestamp <= TIMESTAMP '{VALIDATION_END}'),
    a AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS c,
                 avg(amount) OVER (PARTITION BY account_id ORDER BY t RANGE BETWEEN 2591999999999 PRECEDING AND CURRENT ROW) AS m FROM w)
    SELECT transaction_id, c::DOUBLE AS count_tx_last_7d, round(m, 9) AS avg_amt_30d FROM a WHERE timestamp > TIMESTAMP '{TRAIN_END}'""")
def features_with_history(spark, sf):
    parts = temporal_split(events(spark, sf), TRAIN_END, VALIDATION_END)
    return shown(features.features_with_history(parts.train, parts.validation, 400.0), "count_tx_last_7d", "avg_amt_30d")


# Graph

_TRANSFERS = "pairs AS (SELECT least(account_id, counterparty_account_id) AS src, greatest(account_id, counterparty_account_id) AS dst, amount FROM tx WHERE account_id <> counterparty_account_id), te AS (SELECT src, dst, sum(amount) AS weight, count(*)::DOUBLE AS tx_count FROM pairs GROUP BY 1, 2)"
_SHARED = """seen AS (SELECT DISTINCT 'device_id' AS kind, device_id AS value, account_id AS id FROM tx UNION SELECT DISTINCT 'ip_address', ip_address, account_id FROM tx),
    fit AS (SELECT kind, value FROM seen GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 50),
    sh AS (SELECT a.id AS src, b.id AS dst, count(*)::DOUBLE AS shared_attrs FROM seen a JOIN fit USING (kind, value) JOIN seen b USING (kind, value) WHERE a.id < b.id GROUP BY 1, 2)"""
_GRAPH = f"""{EVENTS_SQL}, {_TRANSFERS}, {_SHARED},
    e AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight, sum(tx_count) AS tx_count, sum(shared_attrs) AS shared_attrs FROM (SELECT src, dst, weight, tx_count, 0.0 AS shared_attrs FROM te UNION ALL SELECT src, dst, shared_attrs, 0.0, shared_attrs FROM sh) GROUP BY 1, 2),
    e2 AS MATERIALIZED (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
    v AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT account_id AS id FROM tx UNION ALL SELECT src FROM e2))"""


@query(f"WITH {EVENTS_SQL}, {_TRANSFERS} SELECT src, dst, round(weight, 4) AS weight, tx_count FROM te")
def transfer_edges(spark, sf):
    return graph.transfer_edges(events(spark, sf)).select("src", "dst", F.round("weight", 4).alias("weight"), "tx_count")


@query(f"WITH {EVENTS_SQL}, {_SHARED} SELECT src, dst, shared_attrs FROM sh")
def shared_attr_edges(spark, sf):
    return graph.shared_attribute_pairs(events(spark, sf))


def _edges(spark, sf):
    return graph.account_edges(events(spark, sf))


@query(f"WITH {_GRAPH} SELECT src, dst, round(weight, 4) AS weight, tx_count::DOUBLE AS tx_count, shared_attrs::DOUBLE AS shared_attrs FROM e")
def account_graph_edges(spark, sf):
    return _edges(spark, sf).select("src", "dst", F.round("weight", 4).alias("weight"), "tx_count", "shared_attrs")


@query(f"WITH {_GRAPH} SELECT src AS id, count(*)::DOUBLE AS graph_degree, round(sum(weight), 4) AS graph_weighted_degree FROM e2 GROUP BY 1")
def degrees(spark, sf):
    return graph.degrees(_edges(spark, sf)).select("id", "graph_degree", F.round("graph_weighted_degree", 4).alias("graph_weighted_degree"))


@query(f"""
    WITH {_GRAPH}, p AS (SELECT DISTINCT account_id AS a, counterparty_account_id AS b FROM tx),
    m AS (SELECT p.a, p.b, count(*) AS n FROM p JOIN e2 x ON x.src = p.a JOIN e2 y ON y.src = p.b AND y.dst = x.dst GROUP BY 1, 2),
    d AS (SELECT src AS id, count(*) AS d FROM e2 GROUP BY 1)
    SELECT transaction_id, coalesce(n, 0)::DOUBLE AS common_neighbors, round(coalesce(n * 1.0 / (da.d + db.d - n), 0), 9)::DOUBLE AS jaccard_similarity
    FROM tx LEFT JOIN m ON m.a = account_id AND m.b = counterparty_account_id LEFT JOIN d da ON da.id = account_id LEFT JOIN d db ON db.id = counterparty_account_id""")
def link_prediction(spark, sf):
    return shown(graph.link_features(events(spark, sf), _edges(spark, sf)), "common_neighbors", "jaccard_similarity")


_STEPS = 6


def _pagerank_sql() -> str:
    steps = "x0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM v) AS x FROM v), wd AS MATERIALIZED (SELECT src, sum(weight) AS w FROM e2 GROUP BY 1)"
    for k in range(_STEPS):
        steps += f""",
        g{k} AS (SELECT e2.dst AS id, sum(x.x * e2.weight / wd.w) AS got FROM e2 JOIN x{k} x ON x.id = e2.src JOIN wd ON wd.src = e2.src GROUP BY 1),
        x{k + 1} AS MATERIALIZED (SELECT v.id, 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(x), 0) FROM x{k} WHERE id NOT IN (SELECT src FROM wd)) / (SELECT count(*) FROM v)) + 0.15 / (SELECT count(*) FROM v) AS x
                 FROM v LEFT JOIN g{k} g USING (id))"""
    return f"WITH {_GRAPH}, {steps} SELECT id, round(x, 8) AS graph_pagerank FROM x{_STEPS}"


@query(_pagerank_sql())
def pagerank_steps(spark, sf):
    edges = written(_edges(spark, sf))
    return graph.pagerank(graph.vertices(events(spark, sf), edges), edges, steps=_STEPS, tol=None).select("id", F.round("graph_pagerank", 8).alias("graph_pagerank"))


_NATION_GRAPH = """e AS (SELECT DISTINCT 'S' || s_suppkey AS src, 'T' || (s_suppkey % 37 * 3 + s_nationkey % 2) AS dst, 1.0 AS weight FROM supplier
    UNION SELECT 'S' || s_suppkey, 'N' || s_nationkey, 1.0 FROM supplier WHERE s_nationkey % 5 <> 0)"""


def _sparse_edges(spark, sf):
    """Suppliers tied to groups and to most nations: a graph with cycles and, where tables are small, several components."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src")
    to = (F.col("s_suppkey") % 37 * 3 + F.col("s_nationkey") % 2).cast("string")
    groups = s.select(own, F.concat(F.lit("T"), to).alias("dst"), F.lit(1.0).alias("weight"))
    return groups.unionAll(s.filter("s_nationkey % 5 <> 0").select(own, F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit(1.0).alias("weight"))).distinct()


@query(f"""
    WITH RECURSIVE {_NATION_GRAPH}, e2 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
    reach AS (SELECT DISTINCT src AS a, src AS b FROM e2 UNION SELECT reach.a, e2.dst FROM reach JOIN e2 ON reach.b = e2.src),
    c AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a)
    SELECT id, component, (count(*) OVER (PARTITION BY component))::DOUBLE AS graph_component_size FROM c""")
def connected_components(spark, sf):
    edges = _sparse_edges(spark, sf)
    return graph.component_sizes(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)


@query(f"""
    WITH {_GRAPH}, top AS (SELECT max(weight) AS m FROM e), n AS MATERIALIZED (SELECT src, dst, weight / m AS w FROM e2, top),
    d AS (SELECT src AS id, count(*) AS d FROM e2 GROUP BY 1),
    t AS (SELECT x.src AS id, sum(cbrt(x.w * y.w * z.w)) AS s FROM n x JOIN n y ON y.src = x.src AND y.dst > x.dst JOIN n z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
    SELECT d.id, round(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(s, 0) / (d * (d - 1)) END, 9) AS graph_clustering FROM d LEFT JOIN t USING (id)""")
def clustering(spark, sf):
    return graph.clustering(written(_edges(spark, sf))).select("id", rounded(F.col("graph_clustering"), "graph_clustering"))


@query(f"""
    WITH {EVENTS_SQL}, m AS (SELECT DISTINCT account_id AS id, 'G' || (CAST(substr(account_id, 2) AS INTEGER) % 7) AS community FROM tx),
    l AS (SELECT account_id AS id, max(label) AS bad FROM tx GROUP BY 1),
    r AS (SELECT community, avg(coalesce(bad, 0)) AS community_risk FROM m LEFT JOIN l USING (id) GROUP BY 1)
    SELECT id, community, round(community_risk, 9) AS community_risk FROM m JOIN r USING (community)""")
def community_risk(spark, sf):
    tx = events(spark, sf)
    members = tx.select(F.col("account_id").alias("id")).distinct().withColumn("community", F.concat(F.lit("G"), (F.substring("id", 2, 9).cast("int") % 7).cast("string")))
    return graph.community_risk(members, tx).select("id", "community", rounded(F.col("community_risk"), "community_risk"))


@query(f"""
    WITH {EVENTS_SQL}, m AS (SELECT DISTINCT account_id AS id, 'G' || (CAST(substr(account_id, 2) AS INTEGER) % 7) AS community FROM tx WHERE timestamp <= TIMESTAMP '2024-01-03'),
    l AS (SELECT account_id AS id, max(label) AS bad FROM tx GROUP BY 1),
    r AS (SELECT community, avg(coalesce(bad, 0)) AS community_risk FROM m LEFT JOIN l USING (id) GROUP BY 1),
    f AS (SELECT id, community_risk FROM m JOIN r USING (community))
    SELECT transaction_id, round(coalesce(community_risk, (SELECT avg(community_risk) FROM f)), 9) AS community_risk FROM tx LEFT JOIN f ON f.id = account_id""")
def account_feature_join(spark, sf):
    tx = events(spark, sf)
    early = tx.filter(F.col("timestamp") <= F.lit("2024-01-03").cast("timestamp"))
    members = early.select(F.col("account_id").alias("id")).distinct().withColumn("community", F.concat(F.lit("G"), (F.substring("id", 2, 9).cast("int") % 7).cast("string")))
    return shown(graph.attach_features(tx, graph.community_risk(members, tx)), "community_risk")


@query(f"""
    WITH {_GRAPH}, r AS (SELECT x.src AS id, x.dst AS account_id, round(e.weight, 4) AS weight, row_number() OVER (PARTITION BY x.src ORDER BY x.weight DESC, x.dst) AS rank
    FROM e2 x JOIN e ON e.src = least(x.src, x.dst) AND e.dst = greatest(x.src, x.dst)) SELECT id, account_id, weight, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def top_neighbors(spark, sf):
    return graph.top_neighbors(_edges(spark, sf)).select("id", "account_id", F.round("weight", 4).alias("weight"), "rank")


@query()
def louvain_communities(spark, sf):
    edges = written(_edges(spark, sf))
    return graph.louvain(graph.vertices(events(spark, sf), edges), edges)


_ROUNDS = 5


def _propagation_sql() -> str:
    steps = "l0 AS MATERIALIZED (SELECT id, id AS community FROM v)"
    for k in range(_ROUNDS):
        steps += f""",
        n{k} AS (SELECT e2.src AS id, l.community, count(*) AS n FROM e2 JOIN l{k} l ON l.id = e2.dst GROUP BY 1, 2),
        t{k} AS (SELECT id, community FROM (SELECT *, max(n) OVER (PARTITION BY id) AS most FROM n{k}) WHERE n = most),
        l{k + 1} AS MATERIALIZED (SELECT l.id, CASE WHEN l.community IN (SELECT community FROM t{k} t WHERE t.id = l.id) THEN l.community ELSE coalesce((SELECT min(community) FROM t{k} t WHERE t.id = l.id), l.community) END AS community FROM l{k} l)"""
    return f"WITH {_GRAPH}, {steps} SELECT id, community FROM l{_ROUNDS}"


@query(_propagation_sql())
def label_propagation(spark, sf):
    edges = written(_edges(spark, sf))
    return graph.label_propagation(graph.vertices(events(spark, sf), edges), edges, rounds=_ROUNDS)


_REACH = 28


def _betweenness_sql() -> str:
    """Shortest paths of equal edges, counted level by level; the graph's longest one has fewer edges than _REACH."""
    steps = "p0 AS MATERIALIZED (SELECT id AS s, id AS t, 1.0::DOUBLE AS ways, 0 AS d FROM n), r0 AS (SELECT * FROM p0)"
    for k in range(1, _REACH):
        steps += f""",
        p{k} AS MATERIALIZED (SELECT p.s, x.dst AS t, sum(ways) AS ways, {k} AS d FROM p{k - 1} p JOIN x ON x.src = p.t WHERE NOT EXISTS (SELECT 1 FROM r{k - 1} r WHERE r.s = p.s AND r.t = x.dst) GROUP BY 1, 2),
        r{k} AS MATERIALIZED (SELECT * FROM r{k - 1} UNION ALL SELECT * FROM p{k})"""
    return f"""
    WITH {_NATION_GRAPH}, x AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), n AS (SELECT DISTINCT src AS id FROM x), {steps},
    r AS MATERIALIZED (SELECT * FROM r{_REACH - 1}), c AS (SELECT count(*)::DOUBLE AS n FROM n),
    b AS (SELECT one.t AS id, sum(one.ways * two.ways / whole.ways) AS b FROM r one JOIN r two ON two.s = one.t JOIN r whole ON whole.s = one.s AND whole.t = two.t
          WHERE one.d > 0 AND two.d > 0 AND one.d + two.d = whole.d GROUP BY 1)
    SELECT id, round(coalesce(b, 0) / ((c.n - 1) * (c.n - 2)), 9) AS graph_betweenness FROM n LEFT JOIN b USING (id), c"""


@query(_betweenness_sql())
def betweenness(spark, sf):
    edges = written(_sparse_edges(spark, sf))
    found = graph.betweenness(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), edges)
    return found.select("id", rounded(F.col("graph_betweenness"), "graph_betweenness"))


# Fusion, evaluation

_SCALE = "sc AS (SELECT " + ", ".join(f"quantile_cont({s}, 0.01) AS lo_{s}, quantile_cont({s}, 0.99) AS hi_{s}" for s in risk.SCORES) + " FROM scored)"
_NORM = ", ".join(f"greatest(least(({s} - lo_{s}) / (CASE WHEN hi_{s} > lo_{s} THEN hi_{s} - lo_{s} ELSE 1e-6 END), 1), 0) AS {s}_norm" for s in risk.SCORES)
_FUSED = f"{SCORED_SQL}, {_SCALE}, nm AS (SELECT *, {_NORM} FROM scored, sc), fu AS (SELECT *, ({C.w_supervised} * s_supervised_norm + {C.w_anomaly} * s_anomaly_norm + {C.w_graph} * s_graph_norm) / 1.0 AS final_score FROM nm)"
_BAND = f"CASE WHEN final_score < {LOW} THEN 'low' WHEN final_score < {HIGH} THEN 'medium' ELSE 'high' END"
_BANDED = f"{_FUSED}, b AS (SELECT *, {_BAND} AS risk_band FROM fu)"
_LOSS = f"CASE WHEN risk_band = 'low' AND label = 1 THEN {C.c_fn} WHEN risk_band = 'medium' AND label = 1 THEN {C.c_review} + {C.c_fn} * (1 - {C.catch_rate}) WHEN risk_band = 'medium' THEN {C.c_review} WHEN risk_band = 'high' AND label <> 1 THEN {C.c_fp} ELSE 0 END"


def _fused(spark, sf):
    df = scored_events(spark, sf)
    return risk.fused(df, risk.fit_scale(df))


def _banded(spark, sf):
    return _fused(spark, sf).withColumn("risk_band", band(F.col("final_score"), LOW, HIGH))


@query(f"WITH {_FUSED} SELECT transaction_id, {', '.join(f'round({s}_norm, 9)::DOUBLE AS {s}_norm' for s in risk.SCORES)} FROM fu")
def score_scaling(spark, sf):
    return shown(_fused(spark, sf), *[f"{s}_norm" for s in risk.SCORES])


@query(f"WITH {_BANDED} SELECT transaction_id, round(final_score, 9)::DOUBLE AS final_score, risk_band FROM b")
def risk_bands(spark, sf):
    return _banded(spark, sf).select("transaction_id", rounded(F.col("final_score"), "final_score"), "risk_band")


def _grid_sql() -> str:
    values = ", ".join(f"({i * C.high_points + j}, {lo!r}::DOUBLE, {hi!r}::DOUBLE)" for i, lo in enumerate(risk.grid(C.low_points, 0.05, 0.65)) for j, hi in enumerate(risk.grid(C.high_points, 0.35, 0.95)) if hi > lo)
    loss = _LOSS.replace("risk_band = 'low'", "s < low").replace("risk_band = 'medium'", "s >= low AND s < high").replace("risk_band = 'high'", "s >= high")
    return f"WITH {SCORED_SQL}, r AS (SELECT greatest(least(amount / 500, 1), 0) AS s, label FROM scored), g(place, low, high) AS (VALUES {values}) SELECT round(low, 9) AS low, round(high, 9) AS high, round(sum({loss}), 2)::DOUBLE AS loss FROM g, r GROUP BY place, low, high"


@query(_grid_sql())
def threshold_grid(spark, sf):
    df = scored_events(spark, sf).withColumn("final_score", F.greatest(F.least(F.col("amount") / 500, F.lit(1.0)), F.lit(0.0)))
    return risk.threshold_losses(df).select(rounded(F.col("low"), "low"), rounded(F.col("high"), "high"), F.round("loss", 2).alias("loss"))


@query(_grid_sql().replace("SELECT round(low, 9) AS low, round(high, 9) AS high, round(sum(", "SELECT low, high FROM (SELECT place, round(low, 9) AS low, round(high, 9) AS high, round(sum(") + ") ORDER BY loss, place LIMIT 1")
def tuned_thresholds(spark, sf):
    df = scored_events(spark, sf).withColumn("final_score", F.greatest(F.least(F.col("amount") / 500, F.lit(1.0)), F.lit(0.0)))
    low, high = risk.tune_thresholds(df)
    return spark.createDataFrame([(round(low, 9), round(high, 9))], "low double, high double")


@query(f"WITH {_BANDED} SELECT round(sum({_LOSS}), 2)::DOUBLE AS expected_loss FROM b")
def expected_loss(spark, sf):
    return _banded(spark, sf).agg(F.round(risk.expected_loss(None), 2).alias("expected_loss"))


@query(f"""
    WITH {_BANDED}, m AS (SELECT count(*)::DOUBLE AS n_samples, count(*) FILTER (risk_band <> 'low' AND label = 1)::DOUBLE AS tp_flagged, count(*) FILTER (risk_band <> 'low' AND label <> 1)::DOUBLE AS fp_flagged,
    count(*) FILTER (risk_band = 'low' AND label = 1)::DOUBLE AS fn_low_band, count(*) FILTER (risk_band = 'low' AND label <> 1)::DOUBLE AS tn_low_band, avg(CASE WHEN risk_band = 'high' THEN 1.0 ELSE 0.0 END) AS hb, sum({_LOSS}) AS tl, avg({_LOSS}) AS al FROM b)
    SELECT n_samples, tp_flagged, fp_flagged, fn_low_band, tn_low_band, round(hb, 9)::DOUBLE AS high_block_rate, round(tl, 2)::DOUBLE AS total_economic_loss, round(al, 4)::DOUBLE AS avg_economic_loss_per_tx,
    round(coalesce(tp_flagged / nullif(tp_flagged + fp_flagged, 0), 0), 9) AS precision_flagged, round(coalesce(tp_flagged / nullif(tp_flagged + fn_low_band, 0), 0), 9) AS recall_flagged,
    round(coalesce(2 * tp_flagged / nullif(2 * tp_flagged + fp_flagged + fn_low_band, 0), 0), 9) AS f1_flagged FROM m""")
def evaluation_metrics(spark, sf):
    m = risk.evaluate(_banded(spark, sf)).drop("detection_latency_hours")
    digits = {"total_economic_loss": 2, "avg_economic_loss_per_tx": 4}
    return m.select(*[F.round(c, digits.get(c, 9)).alias(c) for c in m.columns])


@query(f"WITH {EVENTS_SQL} SELECT round(avg(CASE WHEN CAST(transaction_id AS BIGINT) % 4 <> 0 THEN (CAST(transaction_id AS BIGINT) % 48)::DOUBLE END), 9) AS detection_latency_hours FROM tx")
def detection_latency(spark, sf):
    n = F.col("transaction_id").cast("long")
    at = F.when(n % 4 != 0, F.col("timestamp") + F.make_dt_interval(hours=(n % 48).cast("int")))
    df = events(spark, sf).withColumn("detected_at", at).withColumn("risk_band", F.lit("low"))
    return risk.evaluate(df).select(rounded(F.col("detection_latency_hours"), "detection_latency_hours"))


@query(f"WITH {_GRAPH}, f AS (SELECT DISTINCT account_id AS id FROM tx WHERE amount > 485) SELECT round((SELECT count(*) FROM v WHERE id IN (SELECT id FROM f)) / (SELECT count(*) FROM v), 9) AS disruption_rate")
def disruption_rate(spark, sf):
    tx = events(spark, sf)
    return risk.disruption_rate(tx.filter("amount > 485"), graph.vertices(tx, _edges(spark, sf))).select(rounded(F.col("disruption_rate"), "disruption_rate"))


@query(f"WITH {_BANDED} SELECT coalesce(CASE WHEN CAST(transaction_id AS BIGINT) % 11 = 0 THEN NULL ELSE risk_band END, 'unknown') AS risk_band, count(*) AS n, round(count(*) / (SELECT count(*) FROM b), 9) AS share FROM b GROUP BY 1")
def band_counts(spark, sf):
    df = _banded(spark, sf).withColumn("risk_band", F.when(F.col("transaction_id").cast("long") % 11 != 0, F.col("risk_band")))
    return risk.band_counts(df).select("risk_band", "n", rounded(F.col("share"), "share"))


@query(f"WITH {SCORED_SQL} SELECT transaction_id, round((least(amount / 500, 1) + ln(1 + amount) + 3) / 3, 9) AS s_graph FROM scored")
def graph_score(spark, sf):
    df = events(spark, sf).withColumns({"community_risk": F.least(F.col("amount") / 500, F.lit(1.0)), "graph_weighted_degree": F.col("amount"), "common_neighbors": F.lit(3.0)})
    return df.select("transaction_id", rounded(risk.graph_score(df), "s_graph"))


# Simulations


@query(f"WITH {EVENTS_SQL} SELECT transaction_id, round(amount * 1.3 * CASE WHEN regexp_matches(channel, '(?i)international|wire|cross') THEN 2 ELSE 1 END, 9) AS amount FROM tx")
def concept_drift(spark, sf):
    return shown(simulate.concept_drift(events(spark, sf)), "amount")


@query(f"""
    WITH {EVENTS_SQL}, q AS (SELECT quantile_cont(amount, 0.9) AS q FROM tx), s AS (SELECT transaction_id, amount, label = 1 AND amount >= q AS hit FROM tx, q)
    SELECT transaction_id, round(amount, 9) AS amount FROM s WHERE NOT hit UNION ALL SELECT transaction_id || '_split_' || i, round(amount / 4, 9) FROM s, range(1, 5) r(i) WHERE hit""")
def transaction_splitting(spark, sf):
    return shown(simulate.splitting(events(spark, sf), level=0.9), "amount")


@query()
def mimicry(spark, sf):
    df = simulate.mimicry(events(spark, sf).withColumn("hour", F.hour("timestamp")))
    return df.groupBy("label").agg(F.count("*").alias("n"), F.avg("amount").alias("mean_amount"), F.min("amount").alias("least"), F.countDistinct("hour").alias("hours"))


@query(f"""
    WITH {_BANDED}, m AS (SELECT label = 1 AS fraud, substr(md5(transaction_id || ':42'), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS treated FROM b WHERE risk_band = 'medium'),
    n AS (SELECT count(*) FILTER (NOT treated) AS nc, count(*) FILTER (treated) AS nt, count(*) FILTER (NOT treated AND fraud) AS bc, count(*) FILTER (treated AND fraud) AS bt FROM m),
    r AS (SELECT coalesce(bc / nullif(nc, 0), 0) AS c, coalesce((bt - floor(bt * 0.25)) / nullif(nt, 0), 0) AS t, coalesce(floor(nt * 0.03) / nullif(nt, 0), 0) AS o FROM n)
    SELECT round(c, 9)::DOUBLE AS control_fraud_rate, round(t, 9)::DOUBLE AS treatment_fraud_rate, 0.0::DOUBLE AS control_dropout, round(o, 9)::DOUBLE AS treatment_dropout,
           round(t - c, 9)::DOUBLE AS effect_fraud_rate, round(o, 9)::DOUBLE AS effect_dropout FROM r""")
def ab_test(spark, sf):
    out = simulate.ab_test(_banded(spark, sf))
    return out.select(*[rounded(F.col(c).cast("double"), c) for c in out.columns])


@query(f"""
    WITH {_BANDED}, s AS (SELECT final_score AS v, 1 AS b, 0 AS a FROM b UNION ALL SELECT final_score * 1.2, 0, 1 FROM b),
    w AS (SELECT v, sum(sum(b)) OVER o / sum(sum(b)) OVER () - sum(sum(a)) OVER o / sum(sum(a)) OVER () AS gap FROM s GROUP BY v WINDOW o AS (ORDER BY v)),
    k AS (SELECT max(abs(gap)) AS ks, max(abs(gap)) * sqrt((SELECT count(*) FROM b) / 2.0) AS root FROM w),
    p AS (SELECT ks, CASE WHEN root > 0.2 THEN least(1, greatest(0, (SELECT 2 * sum((CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * i * i * root * root)) FROM range(1, 101) t(i)))) ELSE 1 END AS p FROM k)
    SELECT round(ks, 9)::DOUBLE AS ks_distance, round(p, 9)::DOUBLE AS p_value, p < 0.01 AS drifted FROM p""")
def drift_monitor(spark, sf):
    before = written(_banded(spark, sf))
    alarm = risk.drift_alarm(before, before.withColumn("final_score", F.col("final_score") * 1.2))
    return spark.createDataFrame([(round(alarm["ks_distance"], 9), round(alarm["p_value"], 9), bool(alarm["drifted"]))], "ks_distance double, p_value double, drifted boolean")


# Payload


@query(f"""
    WITH {EVENTS_SQL}, t AS (SELECT * FROM tx WHERE timestamp > TIMESTAMP '{VALIDATION_END}')
    SELECT t.transaction_id, count(*) FILTER (h.timestamp >= t.timestamp - INTERVAL 30 DAY)::INTEGER AS tx_count_30d, round(coalesce(avg(h.amount) FILTER (h.timestamp >= t.timestamp - INTERVAL 30 DAY), 0), 9) AS avg_amount_30d,
           coalesce(max(h.amount) FILTER (h.timestamp >= t.timestamp - INTERVAL 30 DAY), 0) AS max_amount_30d, count(h.transaction_id)::INTEGER AS lifetime_tx_count, count(*) FILTER (h.label = 1)::INTEGER AS lifetime_fraud_count
    FROM t LEFT JOIN tx h ON h.account_id = t.account_id AND h.timestamp <= t.timestamp GROUP BY 1""")
def history_summary(spark, sf):
    tx = events(spark, sf)
    out = payload.history_summary(temporal_split(tx, TRAIN_END, VALIDATION_END).test, tx)
    return out.withColumn("avg_amount_30d", F.round("avg_amount_30d", 9))


@query(f"""
    WITH {EVENTS_SQL}, c AS (SELECT transaction_id, unnest([{{'f': 'amount', 'c': amount - 250}}, {{'f': 'balance', 'c': coalesce(balance, 0) - 300}}, {{'f': 'hour', 'c': (hour(timestamp) - 12) * 20.0}}]) AS x FROM tx),
    r AS (SELECT transaction_id, x.f, x.c, row_number() OVER (PARTITION BY transaction_id ORDER BY abs(x.c) DESC, x.f) AS k FROM c)
    SELECT transaction_id, max(CASE WHEN k = 1 THEN f END) AS first, max(CASE WHEN k = 2 THEN f END) AS second FROM r WHERE k <= 2 GROUP BY 1""")
def top_features(spark, sf):
    each = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("double").alias("contribution")) for n, c in (("amount", F.col("amount") - 250), ("balance", F.coalesce("balance", F.lit(0.0)) - 300), ("hour", (F.hour("timestamp") - 12) * 20.0))])
    top = models.top_contributions(each, 2)
    return events(spark, sf).select("transaction_id", top[0]["feature"].alias("first"), top[1]["feature"].alias("second"))


@query(f"""
    WITH {_GRAPH}, {_BANDED.removeprefix(EVENTS_SQL).lstrip().lstrip(',')}, t AS (SELECT * FROM b WHERE timestamp > TIMESTAMP '{VALIDATION_END}'),
    near AS (SELECT src AS id, dst AS account_id, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM e2),
    listed AS (SELECT id, least(count(*), 10) AS neighbors, max(CASE WHEN rank = 1 THEN account_id END) AS first, sum(weight) FILTER (rank <= 10) AS whole FROM near GROUP BY 1),
    past AS (SELECT t.transaction_id, count(h.transaction_id) AS lifetime, count(*) FILTER (h.label = 1) AS frauds, coalesce(max(h.amount) FILTER (h.timestamp >= t.timestamp - INTERVAL 30 DAY), 0) AS most
             FROM t LEFT JOIN tx h ON h.account_id = t.account_id AND h.timestamp <= t.timestamp GROUP BY 1)
    SELECT t.transaction_id, risk_band, coalesce(neighbors, 0)::INTEGER AS neighbors, coalesce(first, '') AS first_neighbor, round(coalesce(whole, 0), 4)::DOUBLE AS neighbor_weight, lifetime::INTEGER AS lifetime_tx_count, frauds::INTEGER AS lifetime_fraud_count, most AS max_amount_30d
    FROM t LEFT JOIN listed ON listed.id = t.account_id JOIN past USING (transaction_id) WHERE risk_band = 'medium'""")
def analyst_payload(spark, sf):
    test = temporal_split(_banded(spark, sf), TRAIN_END, VALIDATION_END).test
    out = payload.score_response(test, payload.analyst_payload(test, events(spark, sf), _edges(spark, sf)))
    near, past = F.col("analyst_payload.graph_neighbors"), F.col("analyst_payload.recent_history")
    whole = F.round(F.aggregate(near, F.lit(0.0), lambda x, n: x + n["weight"]), 4)
    size = F.when(near.isNotNull(), F.size(near)).otherwise(0).cast("int")
    first = F.coalesce(F.get(near, F.lit(0))["account_id"], F.lit(""))
    out = out.filter(F.col("analyst_payload").isNotNull())
    return out.select("transaction_id", "risk_band", size.alias("neighbors"), first.alias("first_neighbor"), F.coalesce(whole, F.lit(0.0)).alias("neighbor_weight"), past["lifetime_tx_count"].alias("lifetime_tx_count"), past["lifetime_fraud_count"].alias("lifetime_fraud_count"), past["max_amount_30d"].alias("max_amount_30d"))


# Models


def _frame(spark, sf):
    return features.build_features(events(spark, sf), 400.0)


@query()
def supervised_scores(spark, sf):
    frame = written(_frame(spark, sf))
    model = models.Supervised.fit(frame, list(features.NUMERIC), list(features.CATEGORICAL), trees=5, depth=4)
    return model.explain(model.transform(frame), 3).select("transaction_id", "s_supervised", "top_features")


@query()
def isolation_scores(spark, sf):
    frame = written(_frame(spark, sf))
    return models.IsolationForest.fit(frame, list(features.NUMERIC)).transform(frame).select("transaction_id", "s_isolation")


@query()
def autoencoder_scores(spark, sf):
    frame = written(_frame(spark, sf))
    return models.Autoencoder.fit(frame, list(features.NUMERIC), epochs=5).transform(frame).select("transaction_id", "s_reconstruction")


@query()
def pca_scores(spark, sf):
    frame = written(_frame(spark, sf))
    return models.pca_reconstruction(frame, list(features.NUMERIC)).select("transaction_id", "s_pca")


@query()
def scored_transactions(spark, sf):
    return flagship(spark, sf)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on the first days of events and scores the rest, end to end."""
    parts = temporal_split(events(spark, sf_dir), TRAIN_END, VALIDATION_END)
    engine = Engine.fit(parts.train, parts.validation, trees=5, depth=4, isolation_trees=50, epochs=5, pagerank_steps=10)
    return engine.predict(parts.test, parts.train.unionByName(parts.validation)).select("transaction_id", "account_id", "timestamp", "amount", "s_supervised", "s_anomaly", "s_graph", "final_score", "risk_band")
