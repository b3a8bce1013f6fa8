"""Hand-computed cases of the risk operators."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.config import RiskConfig, from_dict, load_config
from riskweave.functions.quantiles import exact_quantiles
from riskweave.functions.scalar import steady_sum
from riskweave.operators import features, graph, models, risk, simulate
from riskweave.operators.components import components
from riskweave.operators.schema import standardize, temporal_split
from riskweave.plans import registry
from riskweave.plans.engine import Engine
from riskweave.sources import readers, sinks
from riskweave.streaming.score import score_stream, velocity_windows

T0 = datetime(2025, 1, 1)
TX = "transaction_id string, account_id string, timestamp timestamp, amount double, label int"


def tx(spark, rows, schema=TX):
    return spark.createDataFrame(rows, schema)


def edge(spark, pairs):
    return spark.createDataFrame([(*sorted(p[:2]), float(p[2]) if len(p) > 2 else 1.0, 1.0, 0.0) for p in pairs], "src string, dst string, weight double, tx_count double, shared_attrs double")


def nodes(spark, edges):
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def test_ties_count_by_position(spark):
    rows = [(str(k), "A", T0 + timedelta(hours=h), 1.0, 0) for k, h in enumerate([0, 1, 1, 1, 2])]
    got = features.tie_exact(tx(spark, rows), "1h").orderBy("transaction_id").collect()
    assert [r.tie_count for r in got] == [1, 1, 2, 3, 1]


def test_tie_exact_medians_against_all_pairs(spark):
    rows = [r[:5] for r in _uneven_rows(300) if r[2] is not None]
    got = features.tie_exact_median(tx(spark, rows), "7D").collect()
    assert len(got) == len(rows)
    for r in got:
        seen = [x[3] for x in rows if x[1] == r.account_id and r.timestamp - timedelta(days=7) < x[2] and (x[2] < r.timestamp or (x[2] == r.timestamp and x[0] <= r.transaction_id))]
        assert r.tie_median == np.median(seen)


def test_forward_filled_balance_counts_again(spark):
    rows = [(str(k), "A", T0 + timedelta(hours=k), 5.0, 0, b) for k, b in enumerate([None, 10.0, None, 40.0])]
    got = features.build_features(tx(spark, rows, TX + ", balance double"), 9.0).orderBy("transaction_id").collect()
    assert [r.avg_balance for r in got] == [0, 10, 10, 20]


def test_only_required_columns(spark):
    got = features.build_features(tx(spark, [("1", "A", T0, 5.0, 0)]), 1.0).first()
    assert (got.device_score, got.merchant_category, got.channel, got.avg_balance, got.account_age_days) == (1.0, "unknown", "unknown", 5.0, 0.0)


def _uneven_rows(n=400):
    """Accounts with gaps of months, ties, late or missing balances, missing accounts and times."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(n):
        when = T0 + timedelta(days=int(rng.choice([0, 1, 29, 30, 31, 200, 201, 290])), hours=int(rng.integers(0, 40)))
        account = str(rng.choice(["A", "A", "A", "B", "C", ""])) or None
        balance = None if when < T0 + timedelta(days=30) or rng.random() < 0.6 else float(rng.integers(1, 900))
        rows.append((f"t{k:03d}", account, None if rng.random() < 0.02 else when, float(rng.integers(1, 500)), int(rng.random() < 0.2), balance))
    return rows


def test_stretches_of_busy_accounts_change_nothing(spark):
    for schema, width in ((TX + ", balance double", 6), (TX, 5)):
        df = tx(spark, [r[:width] for r in _uneven_rows()], schema)
        whole, cut, some = ({r.transaction_id: r for r in features.build_features(df, 300.0, busy=most).collect()} for most in (10**6, 0, 60))
        assert set(whole) == set(cut) == set(some) and len(whole) == 400
        for other in (cut, some):
            for key, row in whole.items():
                for c, value in row.asDict().items():
                    assert other[key][c] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (key, c)


def test_history_summary_against_all_pairs(spark):
    from riskweave.operators.payload import history_summary

    rows = _uneven_rows(250)
    target = rows[::3] + [("new", "D", T0, 1.0, 0, None), ("later", "B", T0 + timedelta(days=900), 1.0, 0, None)]
    schema = TX + ", balance double"
    got = {r.transaction_id: r for r in history_summary(tx(spark, target, schema), tx(spark, rows, schema)).collect()}
    assert len(got) == len(target)
    for key, account, at, *_ in target:
        past = [r for r in rows if account is not None and at is not None and r[1] == account and r[2] is not None and r[2] <= at]
        recent = [r[3] for r in past if r[2] >= at - timedelta(days=30)]
        r = got[key]
        assert (r.tx_count_30d, r.max_amount_30d, r.lifetime_tx_count, r.lifetime_fraud_count) == (len(recent), max(recent, default=0.0), len(past), sum(x[4] for x in past))
        assert r.avg_amount_30d == pytest.approx(sum(recent) / len(recent) if recent else 0.0)


def test_standardize_errors_and_coercion(spark):
    with pytest.raises(ValueError, match="1 timestamps"):
        standardize(spark.createDataFrame([("soon", "1")], "timestamp string, amount string"))
    with pytest.raises(ValueError, match="amount"):
        standardize(spark.createDataFrame([("2025-01-01",)], "timestamp string"))
    row = standardize(spark.createDataFrame([("2025-01-01 10:00", "x", "y", 7, "then")], "timestamp string, amount string, label string, account_id int, account_created_at string")).first()
    assert (row.amount, row.label, row.account_id, row.account_created_at, row.timestamp.hour) == (0.0, 0, "7", None, 10)


def test_split_bounds(spark):
    df = tx(spark, [(str(d), "A", T0 + timedelta(days=d), 1.0, 0) for d in range(6)])
    parts = temporal_split(df, "2025-01-02", "2025-01-04")
    assert [p.count() for p in parts] == [2, 2, 2]
    with pytest.raises(ValueError, match="after"):
        temporal_split(df, "2025-01-04", "2025-01-02")
    with pytest.raises(ValueError, match="empty"):
        temporal_split(df, "2025-01-02", "2025-02-04")


def test_missing_counterparty_is_no_hub(spark):
    df = tx(spark, [("1", "A", T0, 1.0, 0, None), ("2", "B", T0, 2.0, 0, None), ("3", "A", T0, 4.0, 0, "B"), ("4", "B", T0, 4.0, 0, "B")], TX + ", counterparty_account_id string")
    assert [tuple(r) for r in graph.account_edges(df).collect()] == [("A", "B", 4.0, 1.0, 0.0)]


def test_neighbors_of_equal_transfers_rank_by_id_whatever_their_order(spark):
    amounts = {"B": [0.3, 0.2, 0.1], "C": [0.1, 0.2, 0.3], "D": [0.2, 0.1, 0.3]}  # added in turn: 0.6, and 0.6 and a bit
    rows = [(f"{b}{k}", "A", T0, x, 0, b) for b, xs in amounts.items() for k, x in enumerate(xs)]
    df = tx(spark, rows, TX + ", counterparty_account_id string").coalesce(1)
    got = graph.top_neighbors(graph.account_edges(df)).filter("id = 'A'").orderBy("rank").collect()
    assert [r.account_id for r in got] == ["B", "C", "D"] and len({r.weight for r in got}) == 1


def test_steady_sum_is_exact_in_any_order(spark):
    import random

    rng = random.Random(4)
    groups = {
        "cents": [round(rng.uniform(0.01, 900), 2) for _ in range(900)], "both": [round(rng.uniform(-900, 900), 2) for _ in range(900)], "refund": [-0.01], "small": [0.001, -0.1, 0.07],
        "none left": [0.1, 0.2, -0.1, -0.2], "large": [2.0**61, 2.0**60, -(2.0**61), 0.5], "fractions": [rng.random() for _ in range(900)], "nulls": [None, 2.5, None], "nothing": [None, None],
    }
    plain = {"huge": [1e300, 1e300, 5.0], "endless": [math.inf, 1.0], "beyond": [2.0**61.9] * 40, "odd": [math.nan, 1.0]}
    seen = []
    for order in range(3):
        rows = [(g, x) for g, xs in (groups | plain).items() for x in xs]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, x double").repartition(1 + 3 * order)
        seen.append({r.g: r.s for r in df.groupBy("g").agg(steady_sum(F.col("x")).alias("s")).collect()})
    for g, xs in groups.items():
        want = math.fsum(x for x in xs if x is not None) if any(x is not None for x in xs) else None
        assert {s[g] for s in seen} == {seen[0][g]} and (seen[0][g] == want or abs(seen[0][g] - want) <= math.ulp(want)), g
    assert seen[0]["refund"] == -0.01 and seen[0]["huge"] == 2e300 and seen[0]["endless"] == math.inf and seen[0]["odd"] != seen[0]["odd"]
    assert seen[0]["beyond"] == pytest.approx(40 * 2.0**61.9)


def test_shared_attribute_groups_beyond_the_limit_tie_nobody(spark):
    rows = [(f"a{k}", "big") for k in range(51)] + [(f"b{k}", "fit") for k in range(50)]
    got = graph.shared_attribute_pairs(spark.createDataFrame(rows, "account_id string, device_id string"))
    assert got.count() == 50 * 49 // 2


def test_graph_algorithms_on_known_graphs(spark):
    k4 = edge(spark, [(a, b) for a in "abcd" for b in "abcd" if a < b])
    assert {r.graph_clustering for r in graph.clustering(k4).collect()} == {1.0}
    star = edge(spark, [("h", x) for x in "abcd"])
    assert {r.id: r.graph_betweenness for r in graph.betweenness(nodes(spark, star), star).collect()} == {"h": 1.0, **dict.fromkeys("abcd", 0.0)}
    assert abs(graph.pagerank(nodes(spark, star), star).agg(F.sum("graph_pagerank")).first()[0] - 1) < 1e-9
    path = edge(spark, [(f"{k:03}", f"{k + 1:03}") for k in range(40)] + [("x", "y")])
    sizes = {r.id: (r.component, r.graph_component_size) for r in graph.component_sizes(nodes(spark, path), path).collect()}
    assert sizes["040"] == ("000", 41.0) and sizes["y"] == ("x", 2.0)
    bridge = edge(spark, [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")])
    for found in (graph.louvain(nodes(spark, bridge), bridge), graph.label_propagation(nodes(spark, bridge), bridge)):
        homes = {r.id: r.community for r in found.collect()}
        assert len({homes[c] for c in "abc"}) == 1 and len({homes[c] for c in "xyz"}) == 1
    assert {homes["a"], homes["z"]} == {homes["a"], homes["z"]}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_makes_numbered_parts(spark):
    df = tx(spark, [(str(k), "A", T0, float(k), int(k in (1, 100))) for k in range(1, 101)])
    got = simulate.splitting(df)
    assert got.count() == 103 and sorted(r.transaction_id for r in got.filter("amount = 25.0").collect()) == ["100_split_1", "100_split_2", "100_split_3", "100_split_4", "25"]
    assert simulate.splitting(df, factor=1).count() == 100


def test_drift_and_mimicry(spark):
    df = tx(spark, [("1", "A", T0, 10.0, 0, "Wire"), ("2", "A", T0, 10.0, 1, "card"), ("3", "A", T0, 30.0, 0, None)], TX + ", channel string")
    assert {r.transaction_id: round(r.amount, 6) for r in simulate.concept_drift(df).collect()} == {"1": 26.0, "2": 13.0, "3": 39.0}
    changed = {r.transaction_id: r.amount for r in simulate.mimicry(df).collect()}
    assert changed["1"] == 10.0 and changed["2"] >= 1.0
    assert simulate.mimicry(df.filter("label = 0")).agg(F.sum("amount")).first()[0] == 40.0


def banded(spark, counts):
    rows = [(b, y) for (b, y), n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "risk_band string, label int").withColumn("timestamp", F.lit(T0))


@pytest.mark.parametrize(
    ("counts", "loss"),
    [
        ({("high", 1): 19, ("high", 0): 13, ("medium", 0): 15, ("low", 0): 697}, 1095.0),
        ({("high", 1): 17, ("high", 0): 65, ("medium", 0): 10, ("low", 0): 685}, 4955.0),
        ({("high", 1): 11, ("high", 0): 64, ("medium", 0): 10, ("low", 1): 6, ("low", 0): 686}, 3628880.0),
    ],
)
def test_published_losses(spark, counts, loss):
    got = risk.evaluate(banded(spark, counts)).first()
    assert got.total_economic_loss == loss and got.n_samples == sum(counts.values()) and got.detection_latency_hours is None


def test_threshold_search_equals_trying_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(float(s), int(y)) for s, y in zip(rng.random(300), rng.random(300) < 0.05, strict=True)]
    c = RiskConfig()
    best = None
    for lo in risk.grid(25, 0.05, 0.65):
        for hi in risk.grid(25, 0.35, 0.95):
            if hi > lo:
                loss = sum(c.c_fn * y if s < lo else (c.c_review + c.c_fn * (1 - c.catch_rate) * y) if s < hi else c.c_fp * (1 - y) for s, y in rows)
                if best is None or loss < best[0] - 1e-6:
                    best = loss, lo, hi
    assert risk.tune_thresholds(spark.createDataFrame(rows, "final_score double, label int")) == best[1:]


def test_exact_quantiles_narrow_down(spark, monkeypatch):
    import numpy as np

    from riskweave.functions import quantiles

    monkeypatch.setattr(quantiles, "FETCH", 10)
    values = [float(v) for v in np.random.default_rng(0).lognormal(0, 2, 3000)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    assert np.allclose(exact_quantiles(df, "v", [0.0, 0.013, 0.5, 0.95, 1.0]), np.quantile(values, [0.0, 0.013, 0.5, 0.95, 1.0]))
    assert exact_quantiles(df.limit(0), "v", [0.5]) == [None]


def test_explanations_are_the_largest(spark):
    row = spark.range(1).select(models.top_contributions(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(v).alias("contribution")) for n, v in (("a", 1.0), ("b", -3.0), ("c", 3.0), ("d", 0.5))]), 2).alias("t")).first()
    assert [x.feature for x in row.t] == ["b", "c"]


def test_drift_alarm(spark):
    a = spark.range(1000).select((F.col("id") / 1000).alias("final_score"))
    assert not risk.drift_alarm(a, a)["drifted"] and risk.drift_alarm(a, a.select((F.col("final_score") / 2).alias("final_score")))["drifted"]
    assert risk.drift_alarm(a, a, loss_before=100, loss_after=120)["drifted"]


def test_sources_and_sinks(spark, tmp_path):
    df = readers.generate(spark, 500)
    assert df.count() == 500 and df.columns[0] == "transaction_id"
    sinks.write_scored(df, f"{tmp_path}/t.csv", "csv")
    sinks.write_scored(df, f"{tmp_path}/t.parquet")
    assert standardize(readers.read_transactions(spark, f"{tmp_path}/t.csv")).count() == readers.read_transactions(spark, f"{tmp_path}/t.parquet").count() == 500
    with pytest.raises(FileNotFoundError):
        readers.read_transactions(spark, f"{tmp_path}/none.csv")
    with pytest.raises(ValueError, match="not a Parquet"):
        readers.read_transactions(spark, f"{tmp_path}/t.json")
    sinks.write_json(spark, {"a": math.nan, "b": [math.inf, 1.0]}, f"{tmp_path}/m.json")
    assert readers.read_json_report(spark, f"{tmp_path}/m.json") == {"a": None, "b": [None, 1.0]}
    assert readers.read_json_report(spark, f"{tmp_path}/absent.json") is None
    (tmp_path / "bad.json").write_text("{")
    assert readers.read_json_report(spark, f"{tmp_path}/bad.json") is None
    (tmp_path / "files").mkdir()
    for name in ("b.txt", "a.txt"):
        (tmp_path / "files" / name).write_text("x")
    assert [(r.name, r.size_bytes) for r in readers.artifacts(spark, f"{tmp_path}/files").collect()] == [("a.txt", 1), ("b.txt", 1)]


def test_requests(spark):
    good = {"transaction_id": "1", "account_id": "A", "timestamp": "2025-01-01 00:00:00", "amount": 3}
    assert readers.request_rows(spark, [good], strict=True).first().amount == 3.0
    assert readers.request_rows(spark, [good | {"more": 1}]).first().more == 1
    for bad in (good | {"more": 1}, good | {"amount": -1}, {"amount": 1}):
        with pytest.raises(ValueError):
            readers.request_rows(spark, [bad], strict=True)
    with pytest.raises(ValueError):
        readers.request_rows(spark, [])


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"risk": {"costs": {"review_catch_rate": 0.5}, "weights": {"graph": 1}}, "graph": {"use_louvain": False}, "columns": {"label": "y"}}))
    c = load_config(tmp_path / "c.json")
    assert (c.risk.catch_rate, c.risk.w_graph, c.risk.c_fn, c.graph.use_louvain, c.columns.label) == (0.5, 1, 604000.0, False, "y")
    assert from_dict({}) == from_dict({"unknown": 1})
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "d.json")


def test_engine_end_to_end(spark, sf, tmp_path):
    parts = temporal_split(registry.events(spark, sf), registry.TRAIN_END, registry.VALIDATION_END)
    engine = Engine.fit(parts.train, parts.validation, trees=2, depth=3, isolation_trees=10, epochs=1, pagerank_steps=3)
    scored = engine.predict(parts.test, parts.train).cache()
    assert scored.count() == parts.test.count() and set(r[0] for r in scored.select("risk_band").distinct().collect()) <= {"low", "medium", "high"}
    assert engine.payload(scored, parts.train).filter(F.size("analyst_payload.top_features") == 5).count() == scored.count()
    engine.save(f"{tmp_path}/engine")
    again = Engine.load(spark, f"{tmp_path}/engine").predict(parts.test, parts.train)
    gap = scored.select("transaction_id", "final_score").join(again.select("transaction_id", F.col("final_score").alias("b")), "transaction_id").agg(F.max(F.abs(F.col("final_score") - F.col("b")))).first()[0]
    assert gap < 1e-6
    with pytest.raises(ValueError):
        Engine.load(spark, f"{tmp_path}/none")


def test_streams(spark, tmp_path):
    rows = [(str(k), "A" if k % 2 else "B", T0 + timedelta(minutes=10 * k), float(k), 0) for k in range(40)]
    tx(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(TX).parquet(f"{tmp_path}/in")
    for again in ("ck", "lost"):  # a batch that is run again adds nothing
        score_stream(stream, lambda batch, known: batch.withColumn("final_score", F.col("amount")), tx(spark, rows[:5]), f"{tmp_path}/out", f"{tmp_path}/{again}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
    q = velocity_windows(spark.readStream.schema(TX).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("velocity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("velocity").agg(F.sum("n")).first()[0] == 40


def test_quantiles_with_infinite_values(spark, monkeypatch):
    from riskweave.functions import quantiles

    monkeypatch.setattr(quantiles, "FETCH", 10)
    inf = float("inf")
    values = [float(k) for k in range(100)] + [inf] * 20 + [-inf] * 5 + [float("nan"), None] + [1e308, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    kept = sorted(v for v in values if v is not None and v == v)
    n = len(kept)
    for q in (0.0, 0.02, 0.3, 0.5, 0.8, 0.99, 1.0):
        (got,) = quantiles.exact_quantiles(df, "v", [q])
        at = q * (n - 1)
        lo, hi = kept[int(at)], kept[min(int(at) + 1, n - 1)]
        assert got == lo if lo == hi or at == int(at) else abs(got - (lo + (hi - lo) * (at - int(at)))) < 1e-9 * max(1, abs(lo))
    tight = spark.createDataFrame([(1.0 + k * 2.0**-52,) for k in range(3)] * 20, "v double")
    assert quantiles.exact_quantiles(tight, "v", [0.5]) == [1.0 + 2.0**-52]


def test_scratch_tables_need_a_shared_folder_off_local_masters():
    from types import SimpleNamespace

    from riskweave.sources import scratch

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://far:7077", applicationId="x"))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.scratch_root(far)


def plain_graph(n, p, seed):
    import random

    rng = random.Random(seed)
    return [(f"v{a:03d}", f"v{b:03d}", round(rng.uniform(0.1, 5), 3)) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


@pytest.mark.parametrize("side", [128, 3])
def test_clustering_and_link_features_against_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(graph, "SIDE", side)
    monkeypatch.setattr(graph, "TASK_PAIRS", 20)
    monkeypatch.setattr(graph, "PART", 4 if side == 3 else 100)
    rows = plain_graph(24, 0.3, 1) + [("x", "y", 1.0)]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    top, near = max(w for *_, w in rows), {}
    for a, b, w in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w / top
    for r in graph.clustering(df).collect():
        ns = sorted(near[r.id])
        t = sum((near[r.id][u] * near[r.id][v] * near[u][v]) ** (1 / 3) for k, u in enumerate(ns) for v in ns[:k] if v in near[u])
        assert abs(r.graph_clustering - (2 * t / (len(ns) * (len(ns) - 1)) if len(ns) > 1 else 0)) < 1e-9
    ids = sorted(near) + ["unknown"]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids[::3]] + [(None, "x"), ("x", None)], "account_id string, counterparty_account_id string")
    for r in graph.link_features(pairs, df).collect():
        one, two = (set(near.get(v, ())) for v in (r.account_id, r.counterparty_account_id))
        assert r.common_neighbors == len(one & two) and abs(r.jaccard_similarity - (len(one & two) / len(one | two) if one & two else 0)) < 1e-9


def test_betweenness_counts_shortest_paths(spark, monkeypatch):
    monkeypatch.setattr(graph, "SOURCES", 3)
    rows = plain_graph(12, 0.25, 5)
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    ids = sorted({v for a, b, _ in rows for v in (a, b)})
    inf = float("inf")
    dist = {(u, v): 0.0 if u == v else inf for u in ids for v in ids}
    for a, b, w in rows:
        dist[a, b] = dist[b, a] = w
    for k in ids:
        for u in ids:
            for v in ids:
                dist[u, v] = min(dist[u, v], dist[u, k] + dist[k, v])
    n = len(ids)
    for r in graph.betweenness(nodes(spark, df), df).collect():  # weights differ, so shortest paths are single
        through = sum(dist[u, v] < inf and abs(dist[u, r.id] + dist[r.id, v] - dist[u, v]) < 1e-9 for u in ids for v in ids if len({u, v, r.id}) == 3)
        assert abs(r.graph_betweenness - through / ((n - 1) * (n - 2))) < 1e-9
    assert {r.graph_betweenness for r in graph.betweenness(nodes(spark, df), df, limit=5).collect()} == {0.0}


@pytest.mark.parametrize("weights", ["equal", "few", "any"])
def test_betweenness_with_many_accounts_of_the_same_links(spark, monkeypatch, weights):
    monkeypatch.setattr(graph, "SOURCES", 4)
    rows = [(a, b, {"equal": 2.0, "few": 1.0 + int(a[1:]) % 2, "any": w}[weights]) for a, b, w in plain_graph(9, 0.4, 3)]
    hub, other = rows[0][:2]
    rows += [(f"t{k}", v, 2.0) for k in range(5) for v in (hub, other)] + [(f"u{k}", hub, 2.0) for k in range(4)] + [("z", hub, 0.0)] * (weights == "any")
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    got = {r.id: r.graph_betweenness for r in graph.betweenness(nodes(spark, df), df).collect()}
    ids = sorted(got)
    near = {v: {} for v in ids}
    for a, b, w in rows:
        near[a][b] = near[b][a] = w
    dist = {u: {v: 0.0 if u == v else near[u].get(v, math.inf) for v in ids} for u in ids}
    for k in ids:
        for u in ids:
            for v in ids:
                dist[u][v] = min(dist[u][v], dist[u][k] + dist[k][v])

    def paths(s, t, seen):
        if s == t:
            yield seen
            return
        for u, w in near[s].items():
            if u not in seen and abs(w + dist[u][t] - dist[s][t]) < 1e-9:
                yield from paths(u, t, (*seen, u))

    want = dict.fromkeys(ids, 0.0)
    for s in ids:
        for t in ids:
            if s != t and dist[s][t] < math.inf:
                every = list(paths(s, t, (s,)))
                for p in every:
                    for v in p[1:-1]:
                        want[v] += 1 / len(every) / ((len(ids) - 1) * (len(ids) - 2))
    assert all(abs(got[v] - want[v]) < 1e-9 for v in ids)


def test_betweenness_starts_once_for_all_accounts_of_the_same_links(spark):
    rows = [(f"s{k}", h, 1.0) for k in range(500) for h in (f"h{k % 5}", f"h{(k + 1) % 5}")]
    df = spark.createDataFrame(rows, "src string, dst string, weight double")
    twins, links = graph._twins(df)
    assert twins.select("twin").distinct().count() == 10 and links.count() == 10


def test_louvain_by_joins_finds_the_cliques(spark):
    cliques = [[f"{c}{k}" for k in range(6)] for c in "abcd"]
    rows = [(u, v, 1.0) for c in cliques for i, u in enumerate(c) for v in c[i + 1 :]] + [(cliques[i][0], cliques[(i + 1) % 4][1], 0.1) for i in range(4)]
    df = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in rows], "src string, dst string, weight double")
    for largest in (10**6, 0):
        assert {r.id: r.community for r in graph.louvain(nodes(spark, df), df, largest).collect()} == {v: c[0] for c in cliques for v in c}


def test_early_stopping_and_settings(spark, tmp_path):
    rows = [(float(k % 7), float(k % 3), "c", int(k % 7 > 3)) for k in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, c string, label int")
    whole = models.Supervised.fit(df, ["x", "y"], ["c"], trees=12, depth=3)
    noise = df.withColumn("label", (F.rand(3) < 0.5).cast("int"))
    stopped = models.Supervised.fit(df, ["x", "y"], ["c"], trees=12, depth=3, validation=noise)
    assert stopped.model.stages[-1].getNumTrees < whole.model.stages[-1].getNumTrees == 12
    linear = models.Supervised.fit(df, ["x", "y"], ["c"], trees=20, algorithm="svc")
    marks = linear.transform(df).groupBy("label").agg(F.avg("s_supervised").alias("m"), F.min("s_supervised").alias("lo"), F.max("s_supervised").alias("hi")).orderBy("label").collect()
    assert marks[0].m < marks[1].m and 0 <= marks[0].lo and marks[1].hi <= 1 and linear.explain(df, 1).first().top_features[0].feature == "x"
    (tmp_path / "c.json").write_text(json.dumps({"supervised": {"params": {"n_estimators": 7, "max_depth": 2, "learning_rate": 0.2}, "early_stopping_rounds": 0}, "anomaly": {"isolation_forest": {"n_estimators": 9}, "autoencoder": {"hidden_dims": [8, 4], "latent_dim": 2}}, "monitoring": {"drift_ks_pvalue_trigger": 0.2, "loss_increase_trigger_pct": 5}}))
    c = load_config(tmp_path / "c.json")
    assert c.boosting() == {"step": 0.2, "trees": 7, "depth": 2, "stopping": False} and c.isolation() == {"trees": 9}
    assert c.autoencoder() == {"latent": 2, "hidden": (8, 4)} and c.triggers() == {"p_value": 0.2, "loss_pct": 5}


def test_anomaly_models_read_all_rows_whatever_the_partitions(spark):
    df = spark.range(3000).select(F.sin("id").alias("x"), F.cos("id").alias("y"), (F.sin("id") * 2).alias("z"))
    one, two = (models.IsolationForest.fit(d, ["x", "y", "z"], trees=60, size=64) for d in (df.repartition(1), df.repartition(7)))
    assert np.allclose(one.mean, two.mean) and np.allclose(one.score(df.toPandas().to_numpy()), two.score(df.toPandas().to_numpy()), atol=1e-6)
    odd = np.array([[9.0, -9.0, 9.0], [0.1, 0.99, 0.2]])
    assert one.score(odd)[0] > one.score(odd)[1] and two.score(odd)[0] > two.score(odd)[1]
    coder = models.Autoencoder.fit(df, ["x", "y", "z"], latent=2, hidden=(16, 8, 2, 8, 16), epochs=15, batch=64, rate=5e-3)
    assert coder.score(odd)[0] > 5 * coder.score(odd)[1]
    assert models.Autoencoder.fit(df.limit(0), ["x", "y"], epochs=2).score(np.zeros((1, 2))).shape == (1,)


def test_the_drift_distance_is_exact(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 500), np.concatenate([rng.normal(0.3, 1, 300), [5.0, 5.0, -7.0]])
    every = np.sort(np.concatenate([a, b]))
    want = np.abs(np.searchsorted(np.sort(a), every, "right") / len(a) - np.searchsorted(np.sort(b), every, "right") / len(b)).max()
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x] + [(None,)], "final_score double")
    got, n, m = risk.ks_distance(frame(a), frame(b))
    assert abs(got - want) < 1e-12 and (n, m) == (500, 303) and risk.ks_distance(frame([]), frame(b))[0] == 0.0


def test_commands_write_reports_and_the_dashboard_shows_them(spark, tmp_path):
    from riskweave.plans import commands

    (tmp_path / "c.json").write_text(json.dumps({"supervised": {"params": {"n_estimators": 3, "max_depth": 3}}, "anomaly": {"isolation_forest": {"n_estimators": 10}, "autoencoder": {"epochs": 1}}}))
    run = f"{tmp_path}/run"
    commands.main(["generate", "--output", f"{tmp_path}/tx.parquet", "--rows", "2000", "--fraud-rate", "0.05"], spark)
    ends = ["--input", f"{tmp_path}/tx.parquet", "--config", f"{tmp_path}/c.json", "--train-end", "2025-06-15", "--validation-end", "2025-07-15"]
    report = commands.main(["train", *ends, "--output", run], spark)
    assert report["test"]["n_samples"] > 100 and set(report) == {"thresholds", "validation", "test"}
    told = commands.main(["simulate", *ends, "--engine", f"{run}/engine", "--output", f"{run}/simulation_results.json"], spark)
    assert told["baseline"] == report["test"] and {"concept_drift", "mimicry_attack", "transaction_splitting", "incentive_ab_test"} <= set(told)
    shown = commands.main(["dashboard", "--folder", run], spark)
    assert shown["metrics"]["test"]["n_samples"] == report["test"]["n_samples"] and len(shown["preview"]) == 15 and sum(shown["bands"].values()) == report["test"]["n_samples"]
    assert "metrics.json" in {a["name"] for a in shown["artifacts"]}
    assert commands.dashboard(spark, f"{tmp_path}/none")["preview"] == []
    _service_answers(spark, run, f"{tmp_path}/tx.parquet")


def _service_answers(spark, run, table):
    import threading
    import urllib.error
    import urllib.request

    from riskweave.plans.service import Service, server, shares

    none = Service.load(spark, run, f"{run}/no_engine")
    assert none.answer("GET", "/health")[2] == b'{"status": "ok", "model_loaded": false}'
    assert none.answer("POST", "/score", b'{"transactions": [{}]}')[0] == 503
    service = Service.load(spark, run)
    rows = [json.loads(r[0]) for r in spark.read.parquet(table).orderBy("transaction_id").limit(6).selectExpr("to_json(struct(*))").collect()]
    ask = lambda path, **body: (lambda r: (r[0], json.loads(r[2])))(service.answer("POST", path, json.dumps(body).encode()))
    status, told = ask("/score", transactions=rows[3:], history=rows[:3], include_analyst_payload=True, top_k=25)
    assert status == 200 and told["n"] == 3 and {r["transaction_id"] for r in told["scores"]} == {r["transaction_id"] for r in rows[3:]}
    assert all((r["analyst_payload"] is not None) == (r["risk_band"] == "medium") for r in told["scores"])
    status, told = ask("/score/analyst", transactions=rows, low_latency_mode=True, include_recent_history=False)
    assert status == 200 and told["low_latency_mode"] and [r["analyst_payload"]["top_features"] for r in told["scores"]] == [None] * 6 == [r["analyst_payload"]["recent_history"] for r in told["scores"]]
    status, told = ask("/score/analyst", transactions=rows, top_k=3)
    assert all(len(r["analyst_payload"]["top_features"]) == 3 and r["analyst_payload"]["recent_history"]["lifetime_tx_count"] >= 1 for r in told["scores"])
    assert [ask("/score", transactions=[])[0], ask("/score", transactions=rows, top_k=0)[0], ask("/score", transactions=[{"a": 1}])[0], service.answer("POST", "/score", b"{")[0]] == [400] * 4
    bad = ({"top_k": 21}, {"neighbor_limit": 51}, {"more": 1}, {"transactions": [rows[0] | {"amount": -1}]}, {"transactions": [rows[0] | {"odd": 1}]}, {"transactions": [1]})
    assert [ask("/score/analyst", **({"transactions": rows} | b))[0] for b in bad] == [422] * len(bad)
    assert service.answer("GET", "/artifacts/metrics.json")[2].startswith(b"{") and service.answer("GET", "/artifacts/../tx.parquet")[0] == 404
    assert shares({"low": 3, "high": 1}) == {"low": 0.75, "high": 0.25} and shares({}) == {}
    http = server(service, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{http.server_address[1]}"
    page = urllib.request.urlopen(f"{at}/dashboard").read().decode()
    assert "Risk bands, test" in page and "transaction_splitting" in page
    with pytest.raises(urllib.error.HTTPError, match="404"):
        urllib.request.urlopen(f"{at}/other")
    http.shutdown()
    http.server_close()
