"""Embedding near-duplicates by a forest of random-projection trees.

Equal vectors of a label become one class first. TREES trees are fitted on a bounded sample:
a node splits at the median of a random projection, and a vector within MARGIN of the split
goes down both sides (at most SPILL leaves of a tree). Below the sampled leaves the
recursion goes on, as deep as the number of rows asks for, through the centres of those
leaves, so leaves stay small at any size. Vectors meet in leaves, pairs are verified by
their cosine in double precision, counted in the first leaf they share, and united through
spanning edges only. A crowded leaf is dealt to pairs of blocks, so no task holds all of it.

Groups of near-copies aren't split: a vector of the sample with DENSE others within the link
radius is a pivot, or lies within that radius of one. A pivot's leaf takes all vectors up to
twice the radius away, so whatever links with a vector inside the radius is there too; such a
vector meets all its links in leaves of pivots and goes down no tree. Pivots within twice the
radius of each other share a leaf. Only pairs that no pivot is near depend on the trees.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and those
with a null label or vec_id, link with nothing. Vectors of different sizes don't link. Each
row counts as a vector, so repeated rows link with each other. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import mix, shards, written
from riskweave.operators.components import components
from riskweave.llm.search import finite

TREES, LEAF, SPILL, MARGIN = 8, 96, 4, 0.012
#: Rows the forest is fitted on at most.
SAMPLE = 20_000
#: Vectors of the sample within the link radius of one (itself counted) that make it a pivot.
DENSE = 12
#: Rows of a leaf that one task compares with each other; rows of a block beyond that.
CROWDED, BLOCK = 2048, 1024
BUCKET_ROWS = 20_000


def units(vectors, width: int) -> np.ndarray:
    """Rows of length 1, padded with zeros to width."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v) // 8] = np.frombuffer(v, "<f8")
    peak = np.abs(out).max(1, keepdims=True, initial=0)
    out /= np.where(peak > 0, peak, 1)  # squares can't overflow
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def pivots_of(sample: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pivots, ordered by leaf, and the number of each one's leaf."""
    rough = sample.astype(np.float32)
    near = np.zeros(len(sample), np.int64)
    for a in range(0, len(sample), 512):
        near[a : a + 512] = (rough[a : a + 512] @ rough.T >= least).sum(1)
    reach, covered = _reach(least), np.zeros(len(sample), bool)
    picked: list[int] = []
    heads: list[int] = []
    leaf: list[int] = []
    for k in np.argsort(-near, kind="stable").tolist():
        if near[k] < DENSE:
            break
        if covered[k]:
            continue
        covered |= sample @ sample[k] >= least
        close = np.flatnonzero(sample[heads] @ sample[k] >= reach)
        leaf.append(int(close[0]) if len(close) else len(heads))
        if not len(close):
            heads.append(k)
        picked.append(k)
    order = np.argsort(leaf, kind="stable")
    return sample[np.array(picked, np.int64)[order]], np.array(leaf, np.int64)[order]


def _reach(least: float) -> float:
    """The cosine at twice the link radius."""
    return -1.0 if least <= 0 else 2 * least * least - 1 - 1e-9


class Forest:
    def __init__(self, sample: np.ndarray, rows: int, seed: int = 5, least: float = 0.98):
        width = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.least = least
        self.pivots, self.leaf_of = pivots_of(sample, least)
        loose = sample[~self._near(sample)[1]]
        rows = rows * len(loose) / max(1, len(sample))
        self.trees = []
        for _ in range(TREES):
            nodes: list = []
            self._grow(loose, rng, nodes)
            leaves = [n[2] for n in nodes if n[0] is None]
            number = {id(n): k for k, n in enumerate(n for n in nodes if n[0] is None)}
            self.trees.append((nodes, {k: number.get(id(n)) for k, n in enumerate(nodes)}, np.stack(leaves)))
        per_leaf = rows / max(1, len(self.trees[0][2]))
        self.more = max(0, int(np.ceil(np.log2(max(1.0, per_leaf / LEAF)))))
        self.deeper = rng.standard_normal((TREES, self.more, width))
        self.deeper /= np.linalg.norm(self.deeper, axis=2, keepdims=True) + 1e-300

    def _near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each row is in each pivot leaf, and whether it is within the link radius of a pivot."""
        within, inside = np.zeros((len(x), int(self.leaf_of.max(initial=-1)) + 1), bool), np.zeros(len(x), bool)
        if not len(self.pivots):
            return within, inside
        starts = np.flatnonzero(np.diff(self.leaf_of, prepend=-1))
        for a in range(0, len(x), 256):
            # the best pivot of each leaf says all of it
            best = np.maximum.reduceat(x[a : a + 256] @ self.pivots.T, starts, axis=1)
            within[a : a + 256], inside[a : a + 256] = best >= _reach(self.least), (best >= self.least).any(1)
        return within, inside

    def _grow(self, x: np.ndarray, rng, nodes: list) -> int:
        """Appends the node of x: (direction, split, left, right), or a leaf (None, None, centre)."""
        me = len(nodes)
        nodes.append(None)
        if len(x) > LEAF:
            way = rng.standard_normal(x.shape[1])
            way /= np.linalg.norm(way)
            p = x @ way
            at = float(np.median(p))
            left = p <= at
            if 0.1 < left.mean() < 0.9:
                nodes[me] = (way, at, self._grow(x[left], rng, nodes), self._grow(x[~left], rng, nodes))
                return me
        nodes[me] = (None, None, x.mean(0) if len(x) else np.zeros(x.shape[1]))
        return me

    def codes(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row its leaves' codes over all trees, ascending; the tree is in the top bits."""
        within, inside = self._near(x)
        rows, leaf = np.nonzero(within)
        rows_of, codes_of = [rows], [leaf | TREES << 56]
        loose = np.flatnonzero(~inside)
        for t, (nodes, number, centres) in enumerate(self.trees):
            taken = np.ones(len(x), np.int64)
            stack, at_rows, at_leaf = [(0, loose)], [], []
            while stack:
                k, rows = stack.pop()
                node = nodes[k]
                if not len(rows):
                    continue
                if node[0] is None:
                    at_rows.append(rows)
                    at_leaf.append(np.full(len(rows), number[k]))
                    continue
                p = x[rows] @ node[0] - node[1]
                both = (np.abs(p) < MARGIN) & (taken[rows] < SPILL)
                taken[rows[both]] += 1
                stack += [(node[2], rows[(p <= 0) | both]), (node[3], rows[(p > 0) | both])]
            rows = np.concatenate(at_rows) if at_rows else np.zeros(0, np.int64)
            leaf = np.concatenate(at_leaf) if at_leaf else np.zeros(0, np.int64)
            path = np.zeros(len(rows), np.uint64)
            for way in self.deeper[t]:
                p = x[rows] @ way - (centres @ way)[leaf]
                both = (np.abs(p) < MARGIN) & (taken[rows] < SPILL)
                taken[rows[both]] += 1
                side = (p > 0).astype(np.uint64)
                path = np.concatenate([path * 2 + side, path[both] * 2 + 1 - side[both]])
                rows, leaf = np.concatenate([rows, rows[both]]), np.concatenate([leaf, leaf[both]])
            code = (mix(leaf.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + path) >> np.uint64(8)) | np.uint64(t << 56)
            rows_of.append(rows)
            codes_of.append(code.astype(np.int64))
        rows, codes = np.concatenate(rows_of), np.concatenate(codes_of)
        order = np.lexsort((codes, rows))
        return np.split(codes[order], np.searchsorted(rows[order], np.arange(1, len(x))))


def _place(batches, shared, width: int):
    for batch in batches:
        for a in range(0, batch.num_rows, 2048):
            part = batch.slice(a, 2048)
            codes = shared.value.codes(units(part.column(1).to_pylist(), width))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tolist() for c in codes], pa.list_(pa.int64()))], names=[*part.schema.names, "codes"])


def compare(pdf: pd.DataFrame, width: int, least: float) -> pd.DataFrame:
    """One bucket of leaves: what links each class gains here, and the smallest class it hangs together with."""
    keys = ["code", "label", "size", "one", "two"]
    pdf = pdf.sort_values([*keys, "cid"], kind="stable").reset_index(drop=True)
    x = units(pdf["vec"].tolist(), width)
    cid, own, weight = pdf["cid"].to_numpy(), pdf["own"].to_numpy(), pdf["w"].to_numpy()
    codes = pdf["codes"].to_numpy()
    change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
    starts = np.append(np.flatnonzero(change), len(pdf))
    out_c, out_l, out_r = [], [], []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 2:
            continue
        near = x[a:b] @ x[a:b].T >= least
        np.fill_diagonal(near, False)
        one, two = pdf["one"].iat[a], pdf["two"].iat[a]
        if one != two:  # two blocks: only pairs across them, the rest meets elsewhere
            near &= own[a:b, None] != own[None, a:b]
        hit = np.flatnonzero(near.any(1))
        if not len(hit):
            continue
        near, here = near[np.ix_(hit, hit)], a + hit
        first = near & ~_met_before([codes[i] for i in here], pdf["code"].iat[a])
        links = first @ weight[here]
        root = np.arange(len(hit))
        while True:
            lower = np.minimum(root, np.where(near, root[None, :], len(hit)).min(1))
            if (lower == root).all():
                break
            root = lower
        out_c.append(cid[here])
        out_l.append(links)
        out_r.append(cid[here[root]])
    if not out_c:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("cid", "links", "root")})
    return pd.DataFrame({"cid": np.concatenate(out_c), "links": np.concatenate(out_l).astype(np.int64), "root": np.concatenate(out_r)})


def _met_before(codes: list[np.ndarray], code: int) -> np.ndarray:
    """Pairs that share a leaf whose code is below this one's."""
    lower = [c[: np.searchsorted(c, code)] for c in codes]
    flat = np.concatenate(lower)
    if not len(flat):
        return np.zeros((len(codes), len(codes)), bool)
    kinds, column = np.unique(flat, return_inverse=True)
    member = np.zeros((len(codes), len(kinds)), np.float32)
    member[np.repeat(np.arange(len(codes)), [len(c) for c in lower]), column] = 1
    return member @ member.T > 0


def near_duplicates(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # whatever the label's type, it only says what may link
    rows = rows.withColumn("label", F.col("label").cast("string"))
    fit = finite("embedding") & F.exists("embedding", lambda v: v != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False)))
    classes = rows.filter("fit").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()))
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if n:
        links, edges = _linked(classes, n, width, least)
    else:
        links, edges = (spark.createDataFrame([], s) for s in ("cid long, links long", "a long, b long"))
    whole = components(edges)
    named = classes.select("cid", "label", "embedding", "rep", "w").join(links.withColumnRenamed("cid", "id"), F.col("cid") == F.col("id"), "left").drop("id")
    named = written(named.join(whole, F.col("cid") == F.col("id"), "left").withColumn("component", F.coalesce("component", "cid")))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(named.join(least_id, "component").select("label", "embedding", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.filter("fit").join(named, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(classes: DataFrame, n: int, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    flat = classes.select("cid", F.col("embedding"), "label", F.size("embedding").alias("size"), "w")
    flat = flat.mapInArrow(_as_bytes, "cid long, vec binary, label string, size int, w long")
    draw = F.pmod(F.xxhash64("cid"), F.lit(1_000_000)) < -(-SAMPLE * 1_000_000 // n)
    sample = flat.filter(draw).select("cid", "vec").limit(2 * SAMPLE).collect()
    sample = units([r["vec"] for r in sorted(sample, key=lambda r: r["cid"])], width)
    shared = spark.sparkContext.broadcast(Forest(sample, n, least=least))
    placed = written(flat.mapInArrow(lambda it: _place(it, shared, width), "cid long, vec binary, label string, size int, w long, codes array<long>"))
    entry = placed.withColumn("code", F.explode("codes"))
    crowds = written(entry.groupBy("code", "label", "size").count().filter(F.col("count") > CROWDED))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    if crowds.isEmpty():
        dealt = entry.withColumns({"own": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    else:
        dealt = entry.join(crowds, ["code", "label", "size"], "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).drop("blocks", "count", "other")
    buckets = shards(n * TREES * 2, BUCKET_ROWS)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("code", "label", "size", "one", "two"), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInPandas(lambda pdf: compare(pdf, width, least), "cid long, links long, root long")
    found = written(found)
    return found.groupBy("cid").agg(F.sum("links").alias("links")), found.select(F.col("cid").alias("a"), F.col("root").alias("b"))


def _as_bytes(batches):
    for batch in batches:
        vec = [np.asarray(v, "<f8").tobytes() for v in batch.column(1).to_pylist()]
        yield batch.set_column(1, "vec", pa.array(vec, pa.binary()))
