"""Secret scan: three base patterns, and sliding-window entropy over token-like runs.

The entropy rule takes maximal runs of 20 or more token characters, decides a run's class
by its characters (hex, base64 or plain alphanumeric), and slides a window of WINDOW
characters over it. The Shannon entropy of each window follows from the counts of the
window before it, as one character leaves and one enters. Windows at or over the class's
bound are united to spans. Allow-listed runs (words, paths, identifiers of fixed shape) and
what base spans cover are left out; the rest of an entropy span beside a base span stays.

Nulls: a null text is empty and has no spans. Long texts are read whole, in time linear in
their length. Columns but doc_id and text are not read. Positions count code points, ends exclusive.
Each row is judged alone, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import by_id

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character that a window of WINDOW characters must reach, by class.
BOUNDS = {"hex": 3.2, "alnum": 3.7, "base64": 3.7}
#: Runs that are known not to be secrets.
ALLOW = (
    re.compile(r"[A-Za-z_=/+-]+"),  # words without a digit
    re.compile(r"[0-9_=/+-]+"),  # numbers, dates, rulers
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"(/[a-z0-9_-]*)+"),  # lower-case paths
    re.compile(r"([A-Za-z]+|[0-9]+)([_/=-]+([A-Za-z]+|[0-9]+))*"),  # words and numbers joined by marks
)

_TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def window_entropies(run: str):
    """Shannon entropy of every window of run, from incremental counts."""
    counts: dict[str, int] = {}
    total = 0.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        if i >= WINDOW:
            gone = run[i - WINDOW]
            n = counts[gone]
            counts[gone] = n - 1
            total += _TERM[n - 1] - _TERM[n]
        if i >= WINDOW - 1:
            yield _LOG_WINDOW - total / WINDOW


_LOG_WINDOW = math.log2(WINDOW)


def run_class(run: str) -> str:
    if not run.strip("0123456789abcdefABCDEF"):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def entropy_spans(run: str, at: int) -> list[tuple[int, int]]:
    """United spans of run's windows that reach its class's bound."""
    if any(a.fullmatch(run) for a in ALLOW):
        return []
    bound = BOUNDS[run_class(run)] - 1e-9
    spans: list[list[int]] = []
    for i, h in enumerate(window_entropies(run)):
        if h >= bound:
            if spans and at + i <= spans[-1][1]:
                spans[-1][1] = at + i + WINDOW
            else:
                spans.append([at + i, at + i + WINDOW])
    return [(a, b) for a, b in spans]


def _outside(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of spans that no base span covers; both are in order, spans are apart. One sweep over the two."""
    closed: list[list[int]] = []  # base spans united
    for a, b, _ in base:
        if closed and a <= closed[-1][1]:
            closed[-1][1] = max(closed[-1][1], b)
        else:
            closed.append([a, b])
    out, i = [], 0
    for at, end in spans:
        while i < len(closed) and closed[i][1] <= at:
            i += 1
        k = i
        while k < len(closed) and closed[k][0] < end:
            if closed[k][0] > at:
                out.append((at, closed[k][0]))
            at = max(at, closed[k][1])
            k += 1
        if at < end:
            out.append((at, end))
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of kind) of all spans, by start, then kind."""
    found = []
    if ":" in text or "=" in text:  # the pattern needs one of them
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [(m.start(), m.group()) for m in RUN.finditer(text)]
    # a hex match of 32 lies in a run, and no character beside a run belongs to the match
    found += [(at + m.start(), at + m.end(), 2) for at, run in runs if len(run) >= 32 for m in HEX.finditer(run) if m.end() - m.start() >= 32]
    found += [(a, b, 3) for a, b in _outside([span for at, run in runs for span in entropy_spans(run, at)], sorted(found))]
    return sorted(found, key=lambda s: (s[0], s[2]))


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _scans(batches):
    for batch in batches:
        cols: list[list] = [[], [], [], [], [], []]
        for text in batch.column(1):
            spans = scan(text.as_py() or "")
            base = [s for s in spans if s[2] < 3]
            row = *(sum(s[2] == k for s in base) for k in range(3)), hashlib.sha256(line(base).encode()).hexdigest(), line(spans), len(spans) - len(base)
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, types)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: its counts of each kind, the base spans' digest and all spans."""
    return by_id(docs, "doc_id").mapInArrow(_scans, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def masked(text: str) -> str:
    """text with each stretch that spans cover replaced by its first span's kind in brackets."""
    out, at = [], 0
    for a, b, k in scan(text):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([masked(t.as_py()) if t.is_valid else None for t in texts], pa.string())


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in the text column masked; all columns stay, nulls included."""
    return docs.withColumn(text, F.arrow_udf(_masked, "string").asNondeterministic()(F.col(text).cast("string")).cast(docs.schema[text].dataType))
