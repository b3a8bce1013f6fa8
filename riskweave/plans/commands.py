"""Commands: generate transactions, train an engine and write its reports, simulate, show the dashboard's data, serve.

    spark-submit riskweave/plans/commands.py train --input tx.parquet --output run --train-end 2025-06-30 --validation-end 2025-07-31
"""

from __future__ import annotations

import argparse
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from riskweave.config import EngineConfig, load_config
from riskweave.operators import risk, simulate
from riskweave.operators.schema import standardize, temporal_split
from riskweave.plans.engine import Engine
from riskweave.sources import readers
from riskweave.sources.sinks import write_json, write_scored


def _parts(spark: SparkSession, a: argparse.Namespace, config: EngineConfig):
    return temporal_split(standardize(readers.read_transactions(spark, a.input), config.columns), a.train_end, a.validation_end)


def generate(spark: SparkSession, a: argparse.Namespace) -> None:
    df = readers.generate(spark, a.rows, a.fraud_rate, a.seed)
    write_scored(df, a.output, "csv" if a.output.endswith(".csv") else "parquet")


def train(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    """The engine, scored validation and test rows, and one report of both parts' metrics and the thresholds."""
    config = load_config(a.config) if a.config else EngineConfig()
    parts = _parts(spark, a, config)
    engine = Engine.fit(parts.train, parts.validation, config)
    engine.save(f"{a.output}/engine")
    report: dict[str, Any] = {"thresholds": {"low": engine.risk.low, "high": engine.risk.high}}
    history = {"validation": parts.train, "test": parts.train.unionByName(parts.validation)}
    for name, before in history.items():
        path = f"{a.output}/{name}_scored.parquet"
        write_scored(engine.predict(getattr(parts, name), before), path)
        report[name] = risk.evaluate(spark.read.parquet(path), config.risk).first().asDict()
    write_json(spark, report, f"{a.output}/metrics.json")
    return report


def simulations(engine: Engine, test: DataFrame, history: DataFrame) -> dict[str, Any]:
    """Metrics of the test rows as they are and under each attack, and the incentive test on the scored rows."""
    attacks = {"baseline": lambda d: d, "concept_drift": simulate.concept_drift, "mimicry_attack": simulate.mimicry, "transaction_splitting": simulate.splitting}
    report: dict[str, Any] = {name: engine.evaluate(attack(test), history).first().asDict() for name, attack in attacks.items()}
    scored = engine.predict(test, history)
    report["incentive_ab_test"] = simulate.ab_test(scored).first().asDict()
    return report


def simulated(spark: SparkSession, a: argparse.Namespace) -> dict[str, Any]:
    config = load_config(a.config) if a.config else EngineConfig()
    parts = _parts(spark, a, config)
    report = simulations(Engine.load(spark, a.engine, config), parts.test, parts.train.unionByName(parts.validation))
    write_json(spark, report, a.output)
    return report


def dashboard(spark: SparkSession, folder: str, scored: str = "test_scored.parquet", limit: int = 15) -> dict[str, Any]:
    """What a dashboard shows of a run's folder: reports, a preview, band counts, files; None or empty where absent."""
    path = f"{folder}/{scored}"
    rows = readers.read_transactions(spark, path) if readers.exists(spark, path) else None
    told = {name: readers.read_json_report(spark, f"{folder}/{name}.json") for name in ("metrics", "simulation_results")}
    listed = [r.asDict() for r in readers.artifacts(spark, folder).collect()]
    if rows is None:
        return told | {"preview": [], "bands": {}, "artifacts": listed}
    order = [c for c in ("timestamp", "transaction_id") if c in rows.columns] or rows.columns[:1]
    bands = {r["risk_band"]: r["n"] for r in risk.band_counts(rows).collect()} if "risk_band" in rows.columns else {}
    return told | {"preview": [r.asDict() for r in readers.preview(rows, order, limit).collect()], "bands": bands, "artifacts": listed}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskweave", description="Transaction risk on Spark")
    todo = p.add_subparsers(dest="command", required=True)
    g = todo.add_parser("generate", help="write synthetic transactions")
    g.add_argument("--output", required=True)
    g.add_argument("--rows", type=int, default=50_000)
    g.add_argument("--fraud-rate", type=float, default=0.01)
    g.add_argument("--seed", type=int, default=42)
    for name, text in (("train", "fit an engine and write scored rows and metrics"), ("simulate", "score attacks on the test rows")):
        t = todo.add_parser(name, help=text)
        t.add_argument("--input", required=True)
        t.add_argument("--config")
        t.add_argument("--train-end", required=True)
        t.add_argument("--validation-end", required=True)
        t.add_argument("--output", required=True)
        if name == "simulate":
            t.add_argument("--engine", required=True)
    d = todo.add_parser("dashboard", help="print what a dashboard shows of a run's folder")
    d.add_argument("--folder", required=True)
    s = todo.add_parser("serve", help="answer scoring requests and show a run over HTTP")
    s.add_argument("--folder", required=True)
    s.add_argument("--engine", help="the folder's own by default")
    s.add_argument("--config")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Any:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("riskweave").getOrCreate()
    if a.command == "dashboard":
        return dashboard(spark, a.folder)
    if a.command == "serve":
        from riskweave.plans.service import Service, server

        return server(Service.load(spark, a.folder, a.engine, load_config(a.config) if a.config else EngineConfig()), a.host, a.port).serve_forever()
    return {"generate": generate, "train": train, "simulate": simulated}[a.command](spark, a)


if __name__ == "__main__":
    print(main())
