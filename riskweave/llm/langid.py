"""Language identification with a blended-spectrum string kernel.

A text's features are the presence of its byte n-grams (1 to 3, A-Z lower-cased). The
kernel of two texts is the number of n-grams they share over the root of the product of
their numbers, counted over the n-grams that the landmark texts hold. Nyström: landmarks
give a feature map; one-versus-rest kernel ridge regression is solved in it. As scores are
linear in a text's presence vector, all texts of a batch are scored by one matrix product.

The fit takes a bounded sample of labelled rows, TRAIN_ROWS over all languages, and reads the
first TRAIN_CHARS characters of each, however long it is; prediction takes every whole text.

Nulls: a null text, or one without a letter, is `und` with score 0; rows with a null lang
or doc_id teach nothing. Without any teaching row everything is `und`. Ties go to the
language first in order. Rows are judged alone, so repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import CHUNK_BYTES, chunks, text_buffer

#: Bounds of the fit: rows sampled, characters of a sampled text, landmarks a language.
TRAIN_ROWS, TRAIN_CHARS, LANDMARKS = 1200, 8_000, 24
RIDGE = 1e-2
BATCH_DOCS = 128

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


@dataclass
class Model:
    langs: list[str]
    grams: np.ndarray  # codes of the landmarks' n-grams, ascending
    weights: np.ndarray  # one row per n-gram, one column per language


def gram_codes(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the n-grams that start at each byte, for n of 1 to 3; n is in the code."""
    b = _FOLD[data]
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    return [b, two + np.uint32(1 << 24), three + np.uint32(2 << 24)]


def _presence(text: str, grams: np.ndarray) -> np.ndarray:
    codes = np.concatenate([np.unique(c) for c in gram_codes(np.frombuffer(text.encode(), np.uint8))])
    out = np.zeros(len(grams), np.float32)
    at = np.searchsorted(grams, codes)
    hit = at < len(grams)
    out[at[hit][grams[at[hit]] == codes[hit]]] = 1
    return out


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, lang) in an order that doesn't change from run to run."""
    langs = sorted({lang for _, lang in rows})
    marks = [t for lang in langs for t in [t for t, g in rows if g == lang][:LANDMARKS]]
    grams = np.unique(np.concatenate([np.concatenate(gram_codes(np.frombuffer(t.encode(), np.uint8))) for t in marks])) if marks else np.zeros(0, np.uint32)
    land = np.stack([_presence(t, grams) for t in marks])
    land /= np.sqrt(np.maximum(land.sum(1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((land @ land.T).astype(float))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])  # K_mm ** -1/2 up to a rotation
    x = np.stack([_presence(t, grams) for t, _ in rows])
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    z = (x @ land.T).astype(float) @ root
    y = np.array([[1.0 if g == lang else -1.0 for lang in langs] for _, g in rows])
    z1 = np.hstack([z, np.ones((len(z), 1))])
    w = np.linalg.solve(z1.T @ z1 + RIDGE * len(z) / 100 * np.eye(z1.shape[1]), z1.T @ y)
    weights = np.vstack([land.T.astype(float) @ (root @ w[:-1]), w[-1:]])  # the last row is the offset
    return Model(langs, grams, weights.astype(np.float32))


def _tables(grams: np.ndarray) -> list[np.ndarray]:
    """Column of each n-gram by its code, for n of 1 to 3; the last column means absent."""
    kind = np.int16 if len(grams) < 32_000 else np.int32
    out = [np.full(256**n, len(grams), kind) for n in (1, 2, 3)]
    for n, t in enumerate(out):
        mine = grams >> np.uint32(24) == n if n < 2 else grams >= np.uint32(2 << 24)
        t[grams[mine] - np.uint32(n << 24)] = np.flatnonzero(mine)
    return out


_ready: list = [None, None, None]  # a worker's model, its tables and a workspace


def _mark(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], flat: np.ndarray, width: int) -> None:
    """Marks the n-grams that the documents hold, one row of flat each."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64) * width, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the document's end
    for k, codes in enumerate(gram_codes(data)):
        size = len(codes)
        column = tables[k][codes - np.uint32(k << 24)]
        inside = left[:size] > k
        flat[row[:size][inside] + column[inside]] = 1


def scores(data: np.ndarray, offsets: np.ndarray, model: Model, tables: list[np.ndarray], seen: np.ndarray) -> np.ndarray:
    """One row per document of the chunk: its score for each language. seen: a workspace of zeros."""
    n, width = len(offsets) - 1, len(model.grams) + 1
    flat = seen[: n * width]
    if n == 1:  # a long text in parts that share what an n-gram may span
        for a in range(0, len(data), CHUNK_BYTES):
            part = data[a : a + CHUNK_BYTES + 2]
            _mark(part, np.array([0, len(part)]), tables, flat, width)
    else:
        _mark(data, offsets, tables, flat, width)
    p = flat.reshape(n, width)[:, :-1].astype(np.float32)
    flat[:] = 0
    return p @ model.weights[:-1] / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1)) + model.weights[-1]


def _predicted(shared):
    """An Arrow function of (has_letter, text) to lang_pred and score; only these travel, whatever columns the table has."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = shared.value
        if _ready[0] is not model:
            _ready[:] = model, _tables(model.grams), np.zeros(BATCH_DOCS * (len(model.grams) + 1), np.uint8)
        _, tables, seen = _ready
        names = np.array([*model.langs, "und"], object)
        for has, text in batches:
            letter = np.asarray(has.fill_null(False).to_pylist(), bool)
            data, offsets = text_buffer(text)
            best, score = np.full(len(letter), len(model.langs)), np.zeros(len(letter))
            for a, b in chunks(offsets):
                for i in range(a, b, BATCH_DOCS):
                    j = min(b, i + BATCH_DOCS)
                    s = scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model, tables, seen)
                    best[i:j] = s.argmax(1)
                    score[i:j] = np.clip((s.max(1).astype(float) + 1) / 2, 0, 1)
            best[~letter], score[~letter] = len(model.langs), 0.0
            yield pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return predicted.asNondeterministic()  # so that a filter on the prediction doesn't run it again


def has_letter(text: str = "text") -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, teaches: Column) -> Model:
    """Fits on a sample of the rows for which `teaches` holds: about equally many a language."""
    rows = docs.filter(teaches & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros(0, np.uint32), np.zeros((1, 0), np.float32))
    each = max(1, TRAIN_ROWS // len(counts))
    million = 1_000_000
    rate = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, -(-million * each // v))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(million))
    sample = rows.filter(draw < rate[F.col("lang")]).select(F.substring("text", 1, TRAIN_CHARS).alias("text"), "lang", "doc_id").limit(2 * TRAIN_ROWS).collect()
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in sample), key=lambda r: (hash_order(r[0]), r[1]))
    return fit([(t, g) for _, t, g in got if t]) if any(t for _, t, _ in got) else Model([], np.zeros(0, np.uint32), np.zeros((1, 0), np.float32))


def hash_order(doc: int) -> int:
    """A fixed shuffle of ids, so that landmarks don't follow their order."""
    return (doc * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced."""
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not model.langs:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    own = "__predicted"
    while own in kept:
        own += "_"
    predicted = _predicted(spark.sparkContext.broadcast(model))(has_letter(), F.col("text").cast("string"))
    return docs.select(*kept, predicted.alias(own)).select(*kept, f"{own}.lang_pred", f"{own}.score")


def held_out() -> Column:
    """The fold that no fit sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
