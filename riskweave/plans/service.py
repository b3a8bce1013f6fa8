"""Scoring and a run's reports over HTTP: requests of bounded size, answered by the engine on the driver's session.

GET /, /health, /dashboard, /dashboard/data, /artifacts/<name>; POST /score, /score/analyst.
A request that can't be read is 400, one against the analyst schema 422, without an engine 503.
"""

from __future__ import annotations

import json
from html import escape
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.config import EngineConfig
from riskweave.operators import payload
from riskweave.operators.schema import standardize
from riskweave.plans.engine import MOST_FEATURES, MOST_NEIGHBORS, Engine
from riskweave.sources import readers
from riskweave.sources.scratch import released, written
from riskweave.sources.sinks import json_rows, sanitized

#: Bytes of a request's body.
MOST_BYTES = 64 << 20
#: What both kinds of request may say beside their rows, with the defaults.
SCORE = {"include_analyst_payload": False, "top_k": 5, "neighbor_limit": 10, "low_latency_mode": False, "include_graph_neighbors": True, "include_recent_history": True}
ANALYST = {"top_k": 5, "neighbor_limit": 10, "include_explanations": True, "include_graph_neighbors": True, "include_recent_history": True, "low_latency_mode": False}


class Refused(Exception):
    def __init__(self, status: int, detail: str):
        super().__init__(detail)
        self.status = status


class Service:
    """Answers requests with an engine, which may be missing, and a run's folder."""

    def __init__(self, spark: SparkSession, folder: str, engine: Engine | None = None):
        self.spark, self.folder, self.engine = spark, folder.rstrip("/"), engine

    @classmethod
    def load(cls, spark: SparkSession, folder: str, path: str | None = None, config: EngineConfig = EngineConfig()) -> Service:
        """The engine at path, by default the run's own; without one only scoring is refused."""
        path = path or f"{folder.rstrip('/')}/engine"
        found = readers.exists(spark, f"{path}/engine.json")
        return cls(spark, folder, Engine.load(spark, path, config) if found else None)

    def answer(self, method: str, path: str, body: bytes = b"") -> tuple[int, str, bytes]:
        """Status, content type and body."""
        path = path.partition("?")[0].rstrip("/") or "/"
        try:
            if method == "GET" and path == "/dashboard":
                return 200, "text/html; charset=utf-8", page(self.shown()).encode()
            if method == "GET" and path.startswith("/artifacts/"):
                return 200, "application/octet-stream", self.artifact(path.removeprefix("/artifacts/"))
            told = {
                ("GET", "/"): lambda: {"message": "riskweave is running.", "dashboard": "/dashboard", "health": "/health"},
                ("GET", "/health"): lambda: {"status": "ok", "model_loaded": self.engine is not None},
                ("GET", "/dashboard/data"): self.shown,
                ("POST", "/score"): lambda: self.score(_body(body)),
                ("POST", "/score/analyst"): lambda: self.analyst(_body(body)),
            }.get((method, path))
            if told is None:
                raise Refused(404, f"no {method} {path}")
            with released(self.spark):
                return 200, "application/json", json.dumps(sanitized(told()), default=str).encode()
        except Refused as refused:
            return refused.status, "application/json", json.dumps({"detail": str(refused)}).encode()

    def score(self, asked: dict[str, Any]) -> dict[str, Any]:
        """Scores of the rows; the payload on medium rows if it is asked for."""
        how = SCORE | {k: v for k, v in asked.items() if k in SCORE}
        self._ready(asked)
        for name in ("top_k", "neighbor_limit"):
            if not isinstance(how[name], int) or how[name] < 1:
                raise Refused(400, f"{name} must be at least 1")
        scored, history = self._scored(asked, strict=False)
        seen = self._payload(scored, history, how, bounded=False) if how["include_analyst_payload"] else None
        return _listed(payload.score_response(scored, seen))

    def analyst(self, asked: dict[str, Any]) -> dict[str, Any]:
        """Scores with the payload on every row; the request's schema is strict."""
        if unknown := set(asked) - set(ANALYST) - {"transactions", "history"}:
            raise Refused(422, f"unknown fields: {sorted(unknown)}")
        how = ANALYST | {k: v for k, v in asked.items() if k in ANALYST}
        for name, most in (("top_k", MOST_FEATURES), ("neighbor_limit", MOST_NEIGHBORS)):
            if not isinstance(how[name], int) or not 1 <= how[name] <= most:
                raise Refused(422, f"{name} is 1 to {most}")
        self._ready(asked)
        scored, history = self._scored(asked, strict=True)
        seen = self._payload(scored, history, how)
        return _listed(payload.score_response(scored, seen, only_medium=False)) | {"low_latency_mode": bool(how["low_latency_mode"])}

    def _ready(self, asked: dict[str, Any]) -> None:
        if self.engine is None:
            raise Refused(503, "no engine is loaded")
        if not asked.get("transactions"):
            raise Refused(400, "a request needs transactions")

    def _scored(self, asked: dict[str, Any], strict: bool) -> tuple[DataFrame, DataFrame | None]:
        try:
            rows, before = (readers.request_rows(self.spark, asked[k], strict) if asked.get(k) else None for k in ("transactions", "history"))
            before = None if before is None else standardize(before, self.engine.config.columns)
            return written(self.engine.predict(rows, before)), before
        except (ValueError, TypeError, AttributeError) as error:
            raise Refused(422 if strict else 400, str(error)) from error

    def _payload(self, scored: DataFrame, history: DataFrame | None, how: dict[str, Any], bounded: bool = True) -> DataFrame:
        explain = how.get("include_explanations", True)
        return self.engine.payload(scored, history, how["top_k"], how["neighbor_limit"], explain, how["include_graph_neighbors"], how["low_latency_mode"], how["include_recent_history"], bounded)

    def shown(self) -> dict[str, Any]:
        """The dashboard's data."""
        from riskweave.plans.commands import dashboard

        test, validation = (dashboard(self.spark, self.folder, f"{part}_scored.parquet") for part in ("test", "validation"))
        told = {k: test[k] for k in ("metrics", "simulation_results", "artifacts")} | {"health": {"model_loaded": self.engine is not None}, "metadata": self.engine.metadata() if self.engine else None}
        return told | {f"{n}_{k}": d[v] for n, d in (("test", test), ("validation", validation)) for k, v in (("preview", "preview"), ("risk_bands", "bands"))}

    def artifact(self, name: str) -> bytes:
        """A file of the run's folder, by a name that the listing gives."""
        if name not in {r["name"] for r in readers.artifacts(self.spark, self.folder).select("name").collect()}:
            raise Refused(404, f"no artifact {name}")
        files = self.spark.read.format("binaryFile").load(f"{self.folder}/*").filter(F.element_at(F.split("path", "/"), -1) == name)
        return bytes(files.select("content").first()[0])


def _body(body: bytes) -> dict[str, Any]:
    try:
        asked = json.loads(body)
    except ValueError as error:
        raise Refused(400, "the body isn't JSON") from error
    lists = [asked.get(k) or [] for k in ("transactions", "history")] if isinstance(asked, dict) else [None]
    if not all(isinstance(rows, list) and all(isinstance(r, dict) for r in rows) for rows in lists):
        raise Refused(422, "a request is an object with lists of rows")
    return asked


def _listed(rows: DataFrame) -> dict[str, Any]:
    scores = [json.loads(r[0]) for r in json_rows(rows).collect()]
    return {"n": len(scores), "scores": scores}


def shares(bands: dict[str, int]) -> dict[str, float]:
    """Each band's part of all rows."""
    whole = sum(bands.values())
    return {band: n / whole if whole else 0.0 for band, n in bands.items()}


def _table(title: str, rows: list[dict[str, Any]]) -> str:
    names = list(dict.fromkeys(name for r in rows for name in r))
    text = lambda v: escape("–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join(f"<tr>{''.join(f'<td>{text(r.get(n))}</td>' for n in names)}</tr>" for r in rows)
    return f"<h2>{escape(title)}</h2>" + (f"<table><tr>{head}</tr>{body}</table>" if rows else "<p>none</p>")


def page(data: dict[str, Any]) -> str:
    """The dashboard's data as a page without scripts."""
    of = lambda report: [{"of": name, **told} for name, told in (report or {}).items() if isinstance(told, dict)]
    parts = [_table("Metrics", of(data["metrics"])), _table("Simulations", of(data["simulation_results"]))]
    for part in ("validation", "test"):
        share = shares(data[f"{part}_risk_bands"])
        parts.append(_table(f"Risk bands, {part}", [{"band": b, "rows": n, "share": share[b]} for b, n in data[f"{part}_risk_bands"].items()]))
        parts.append(_table(f"First rows, {part}", data[f"{part}_preview"]))
    parts.append(_table("Artifacts", data["artifacts"]))
    loaded = "an engine is loaded" if data["health"]["model_loaded"] else "no engine is loaded"
    return f"<!doctype html><meta charset=utf-8><title>riskweave</title><h1>riskweave</h1><p>{loaded}</p>{''.join(parts)}"


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server around the service; serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self, method: str) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > MOST_BYTES:
                status, kind, body = 413, "application/json", b'{"detail": "the request is too large"}'
            else:
                status, kind, body = service.answer(method, self.path, self.rfile.read(size))
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._reply("GET")

        def do_POST(self) -> None:
            self._reply("POST")

        def log_message(self, *_: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
