"""Exact top-k inner products over norm-sorted vectors with SVD-rotated partial sums.

Components become integers, floor(256 * x). Candidates are written in order of descending
length, so a task reads a stretch of that order. Queries go in groups of GROUP_BYTES at most,
which are broadcast: candidates stream past them and aren't copied or shuffled again. A
bounded part of the longest candidates gives every query of a group its k-th best score so
far; candidates too short to reach the group's smallest need aren't read. In a task a query
is done with a step of candidates when its length times theirs stays below its k-th score,
and a pair is summed in full only if the leading rotated coordinates plus the Cauchy-Schwarz
bound on the rest reach it. A task gives out at most k rows a query, and only scores that
reach the k-th of the start.

Scores are exact integers: by floating point where products stay below 2**53, by 64-bit
integers or Python's beyond. A score that doesn't fit into 64 bits counts as the nearest
that does.

Vectors that are null or hold null or non-finite components (256 * x included), or whose
vec_id is null, take no part. Shorter vectors count as padded with zeros, empty ones as zero.
Repeated rows are candidates each; a vec_id asks once, with the vector of its rows that is
smallest as bytes, and rows of its own vec_id are no candidates for it. Ties go to the
smaller vec_id. Other columns, whatever their names, are not read. An empty table gives no
rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import shards, written

SCALE = 256
#: Bytes of a broadcast group of queries; candidates of the start and of a chunk; queries and candidates of one step.
GROUP_BYTES, CHUNK, BLOCK, STEP = 16 << 20, 4096, 1024, 512
#: Length bands per doubling, for counts only; lengths past 2**TOP are one band.
BANDS, TOP = 8, 64
FOUND = "query_id long, vec_id long, score long"
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
NONE = -(1 << 63)


def finite(embedding: str):
    c = F.col(embedding)
    return c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _encode(batches):
    """mapInArrow: (vec_id, embedding) to vec_id, whole components as doubles, length."""
    for batch in batches:
        vectors = [np.floor(SCALE * np.asarray(v, float)) for v in batch.column(1).to_pylist()]
        tops = [max(float(np.abs(v).max(initial=0)), 1.0) for v in vectors]
        lengths = [t * float(np.linalg.norm(v / t)) for v, t in zip(vectors, tops, strict=True)]  # squares of large ones overflow
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(lengths, pa.float64())], names=["vec_id", "vec", "length"])


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros."""
    vectors = list(vectors)
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), float).reshape(len(vectors), width)
    return np.stack([np.pad(np.frombuffer(v, float), (0, width - len(v) // 8)) for v in vectors])


def _gram(batches, width: int):
    total = np.zeros((width, width))
    for batch in batches:
        if batch.num_rows:
            m = matrix(batch.column(0).to_pylist(), width) / np.maximum(np.asarray(batch.column(1)), 1e-300)[:, None]
            total += m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "v"])


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows at unit length, strongest first, from the summed Gram matrix."""
    cells = vectors.select("vec", "length").mapInArrow(lambda it: _gram(it, width), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
    gram = np.zeros(width * width)
    for r in cells.collect():  # width squared numbers, whatever the rows
        gram[r["cell"]] = r["v"]
    return np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1].copy()


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows as 64-bit integers, the nearest that fits."""
    out = np.empty((len(q), len(c)), np.int64)
    top, width = float(np.abs(c).max(initial=0)), max(q.shape[1], 1)
    with np.errstate(over="ignore"):
        need = np.abs(q).max(1, initial=0) * top * width
    fast, whole = need < 2.0**53, need < 2.0**62
    out[fast] = (q[fast] @ c.T).astype(np.int64)
    slow = whole & ~fast & (top < 2.0**62)
    if slow.any():
        out[slow] = q[slow].astype(np.int64) @ c.astype(np.int64).T
    rest = ~fast & ~slow
    if rest.any():
        exactly = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
        out[rest] = np.array(np.clip(exactly(q[rest]) @ exactly(c).T, LEAST, MOST).tolist(), np.int64)
    return out


class Search:
    """A group of queries and the best k of the candidates that it has met so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.turn, self.k = ids, q, turn, k
        self.floor = floor.copy()  # scores below can't count; NONE where nothing is known
        self.best = np.full((len(ids), k), NONE, np.int64)
        self.best_id = np.full((len(ids), k), MOST, np.int64)
        self.lead = max(1, len(turn) // 4)
        self.length, self.front, self.rest = self._turned(q)

    def _turned(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, leading rotated coordinates, lengths of the rest."""
        top = np.maximum(np.abs(m).max(1, initial=0), 1.0)
        turned = m / top[:, None] @ self.turn
        norm = lambda x: np.sqrt((x * x).sum(1)) * top
        return norm(turned), turned[:, : self.lead] * top[:, None], norm(turned[:, self.lead :])

    def meet(self, ids: np.ndarray, c: np.ndarray) -> None:
        """Candidates in order of descending length."""
        length, front, rest = self._turned(c)
        for a in range(0, len(c), STEP):
            s = slice(a, a + STEP)
            with np.errstate(over="ignore", invalid="ignore"):
                slack = 1e-9 * (self.length * length[s].max() + 1)
                live = np.flatnonzero((self.floor == NONE) | ~(self.length * length[s].max() + slack < self.floor))
                for i in range(0, len(live), BLOCK):
                    self._step(live[i : i + BLOCK], slack, ids[s], c[s], front[s], rest[s])

    def _step(self, live: np.ndarray, slack: np.ndarray, ids: np.ndarray, c: np.ndarray, front: np.ndarray, rest: np.ndarray) -> None:
        bound = self.front[live] @ front.T + self.rest[live, None] * rest[None, :] + slack[live, None]
        # what overflowed isn't below any floor
        reach = ((self.floor[live, None] == NONE) | ~(bound < self.floor[live, None])) & (self.ids[live, None] != ids[None, :])
        rows, cols = np.flatnonzero(reach.any(1)), np.flatnonzero(reach.any(0))
        if not len(rows):
            return
        who = live[rows]
        score = exact_products(self.q[who], c[cols])
        score[~reach[np.ix_(rows, cols)] | (score < self.floor[who, None])] = NONE
        score = np.hstack([self.best[who], score])
        found = np.hstack([self.best_id[who], np.broadcast_to(ids[cols], (len(who), len(cols)))])
        found[score == NONE] = MOST
        order = np.lexsort((found, ~score), axis=1)[:, : self.k]  # ~score falls as the score rises
        self.best[who], self.best_id[who] = np.take_along_axis(score, order, 1), np.take_along_axis(found, order, 1)
        self.floor[who] = np.maximum(self.floor[who], self.best[who, -1])

    def found(self) -> pa.RecordBatch:
        got = self.best != NONE
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.ids[np.nonzero(got)[0]], self.best_id[got], self.best[got])], names=["query_id", "vec_id", "score"])


def _met(batches, shared, k: int):
    """mapInArrow: (vec_id, vec) by descending length to each query's best k here."""
    ids, q, turn, floor = shared.value
    search = Search(ids, q, turn, floor, k)
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            part = batch.slice(a, CHUNK)
            search.meet(np.asarray(part.column(0)), matrix(part.column(1).to_pylist(), len(turn)))
    yield search.found()


def top_k(embeddings: DataFrame, every: int, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows for each row whose vec_id `every` divides."""
    spark = embeddings.sparkSession
    picked = embeddings.filter(finite("embedding") & F.col("vec_id").isNotNull())
    picked = picked.filter(~F.exists("embedding", lambda x: F.abs(x.cast("double") * SCALE) == float("inf")))
    encoded = picked.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_encode, "vec_id long, vec binary, length double")
    vectors = written(encoded.repartitionByRange(F.desc("length"), F.col("vec_id")).sortWithinPartitions(F.desc("length"), "vec_id"))
    band = F.least(F.floor(F.log2(F.col("length") + 1) * BANDS), F.lit(TOP * BANDS)).cast("int")
    # bands are few, whatever the rows
    bands = sorted(((r["band"], r["n"], r["wide"]) for r in vectors.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("wide")).collect()), reverse=True)
    width = max([1, *(wide // 8 for *_, wide in bands)])
    asked = written(vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    many = asked.count()
    if not many:
        return _ranked(spark.createDataFrame([], FOUND), k)
    turn = rotation(vectors, width)
    start = _start(vectors, band, bands)
    groups = shards(many * (8 * width + 8 * k), GROUP_BYTES)
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    found = spark.createDataFrame([], FOUND)
    for g in range(groups):
        mine = sorted((r["vec_id"], r["vec"]) for r in (asked.filter(deal == g) if groups > 1 else asked).collect())  # GROUP_BYTES at most
        if not mine:
            continue
        ids, q = np.array([i for i, _ in mine], np.int64), matrix([v for _, v in mine], width)
        meet = lambda c, low: c.select("vec_id", "vec").mapInArrow(lambda it, s=spark.sparkContext.broadcast((ids, q, turn, low)): _met(it, s, k), FOUND)  # noqa: B023, E731
        low = np.full(len(ids), NONE, np.int64)
        kth = _ranked(meet(start, low), k).filter(F.col("rank") == k).select("query_id", "score").collect()
        low[np.searchsorted(ids, [r["query_id"] for r in kth])] = [r["score"] for r in kth]
        length = Search(ids, q, turn, low, k).length
        with np.errstate(over="ignore", invalid="ignore"):
            need = 0.0 if (low <= 0).any() else float((low / np.maximum(length, 1e-300)).min()) * (1 - 1e-9)
        part = meet(vectors.filter(F.col("length") >= need) if need > 0 else vectors, low)
        found = found.unionAll(written(part) if groups > 1 else part)
    return _ranked(found, k)


def _start(vectors: DataFrame, band, bands: list[tuple[int, int, int]]) -> DataFrame:
    """About CHUNK of the longest vectors, whose k-th best score is a bound for all."""
    n, low = 0, bands[-1][0]
    for key, count, _ in bands:
        n += count
        if n >= CHUNK:
            low = key
            break
    share = max(1, n // CHUNK)
    return vectors.filter((band >= low) & (F.pmod(F.xxhash64("vec_id", F.lit("start")), F.lit(share)) == 0))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
