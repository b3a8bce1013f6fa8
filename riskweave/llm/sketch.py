"""Near-duplicates on word shingles by SetSketch registers.

A document's set is its distinct 5-word shingles, as 64-bit names made of the words' 128-bit
ones (one to one up to 16 bytes, digests beyond); two different shingles of one pair of
documents share a name with a chance of the product of the set sizes over 2**64. Each hash function gives
an exponentially distributed minimum over the set, kept as a truncated exponent to the base
B (a register); the registers of a union are the larger ones. Bands of registers propose
pairs; a joint likelihood over the registers that are larger, smaller and equal discards
proposals that are far too unlike; the rest is confirmed on the full sets.

Equal sets are one class from the start. In a band's bucket every class is held against the
bucket's smallest class only. Classes that buckets tie together, directly or through others,
are a clump; where a clump still falls into several components, every class outside its
largest one is compared with those of the clump whose sizes admit the similarity, on full
sets, in blocks of bounded bytes inside tasks that put out spanning links only. So no link
is lost and no pairs are written out.

Defined cases: a null text, or one without words, has no shingles and links with nothing; so
does a row with a null doc_id (its component is null). Rows that share a doc_id are one
document for components; `deduplicated` tells them apart by their texts. Repeated rows
repeat; `deduplicated` keeps one of them. Long texts are read in parts that cut no word.
Columns but doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import by_id, chunks, gram_names, mix, signed, text_buffer, word_names, written
from riskweave.operators.components import components

SHINGLE = 5
#: Bands and registers of a band from a similarity (in percent) on: pairs just there miss all bands less than twice in 100,000.
PLANS = ((85, 32, 7), (0, 36, 6))
MOST = 224
#: SetSketch's base, rate and largest register.
B, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
#: A proposal goes if the best admissible similarity is less likely than the best one by this many nats.
UNLIKELY = 15.0

_rng = np.random.default_rng(11)
_FLIP = _rng.integers(0, 1 << 63, MOST, np.uint64)
_MULT = _rng.integers(0, 1 << 62, MOST, np.uint64) * np.uint64(2) + np.uint64(1)
#: Classes of a block of outsiders and of a clump, and bytes of sets of a block and of a task of many blocks.
OUTSIDE, INSIDE, BLOCK_BYTES, TASK_BYTES = 256, 512, 2 << 20, 1 << 20
NAME = ["n_shingles", "f1", "f2"]


def plan(percent: int) -> tuple[int, int]:
    return next((bands, rows) for least, bands, rows in PLANS if percent >= least)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's distinct shingle hashes in ascending order."""
    names, bounds = word_names(data, offsets, lower=True)
    grams = gram_names(names, SHINGLE)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        else:
            out.append(gram_names(names[a:b], b - a) if b > a else grams[:0])
    return out


def registers(shingles: np.ndarray, count: int = MOST) -> np.ndarray:
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(least, ((shingles[a : a + 512, None] ^ _FLIP[:count]) * _MULT[:count]).min(0), out=least)
    x = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(B)), 0, LIMIT).astype("<u2")


def _sketch(batches, count: int):
    """mapInArrow: (doc_id, hash of the text, text) to both, n, two sums that name the set, registers."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(2))
        n, f1, f2, regs = [], [], [], []
        for a, b in chunks(offsets):
            for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                n.append(len(s))
                f1.append(s.sum(dtype=np.uint64))
                f2.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                regs.append(registers(s, count).tobytes() if len(s) else b"")
        f1, f2 = (pa.array(signed(np.array(f, np.uint64))) for f in (f1, f2))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), f1, f2, pa.array(regs, pa.binary())], names=["doc_id", "t", *NAME, "regs"])


def _band_rows(batches, bands: int, rows: int):
    """mapInArrow: (cls, n, regs) to one row per band: its key, the class and its size."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, bands, rows)
        keys = np.arange(bands, dtype=np.uint64)[None, :]
        for k in range(rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, k])
        each = pa.array(np.repeat(np.arange(batch.num_rows), bands))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), batch.column(0).take(each), batch.column(1).take(each)], names=["key", "cls", "n"])


def similarity_loglik(r: np.ndarray, s: np.ndarray, nr: np.ndarray, ns: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of each similarity of the grid for pairs of register rows of sets of nr and ns elements."""
    u, v = (nr / (nr + ns))[:, None], (ns / (nr + ns))[:, None]
    more, less = (r > s).sum(1)[:, None], (r < s).sum(1)[:, None]
    same = r.shape[1] - more - less
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = part(u - v * grid), part(v - u * grid)
    log = lambda x: np.log(np.maximum(x, 1e-12))
    value = more * log(up) + less * log(down) + same * log(1 - up - down)
    return np.where(grid <= np.minimum(u / v, v / u) + 1e-9, value, -np.inf)


def _likely(batches, percent: int):
    """mapInArrow: keeps (a, b) whose registers admit the similarity. Columns: a, b, n_a, n_b, regs_a, regs_b."""
    grid = np.linspace(0, 1, 101)
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (np.asarray(batch.column(i), float) for i in (2, 3))
        ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (4, 5))
        keep = np.zeros(batch.num_rows, bool)
        for i in range(0, batch.num_rows, 2000):
            j = slice(i, i + 2000)
            value = similarity_loglik(ra[j], rb[j], na[j], nb[j], grid)
            keep[j] = value[:, grid >= percent / 100 - 0.01].max(1) >= value.max(1) - UNLIKELY
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def _sets(batches):
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        sets = [s for a, b in chunks(offsets) for s in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(batches, percent: int):
    for batch in batches:
        left, right = ([np.frombuffer(s, np.uint64) for s in batch.column(i).to_pylist()] for i in (2, 3))
        keep = [alike(x, y, percent) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles: the sets of the classes named by ids (one column, id), from a document of each."""
    of = classes.join(ids, F.col("cls") == F.col("id")).select("id", F.col("least.doc_id").alias("doc_id"), F.col("least.t").alias("t"))
    texts = docs.join(of, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])  # dealt as the join is
    return written(texts.select("id", "text").mapInArrow(_sets, "id long, shingles binary"))


def _confirmed(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked."""
    with_a = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "s_a"}), "a")
    with_b = with_a.join(sets.withColumnsRenamed({"id": "b", "shingles": "s_b"}), "b").select("a", "b", "s_a", "s_b")
    return written(with_b.mapInArrow(lambda it: _confirm(it, percent), "a long, b long").distinct())


def _read(docs: DataFrame) -> DataFrame:
    return by_id(docs, "doc_id").withColumn("t", F.xxhash64("text"))


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows' doc_id, t and set, and the classes of equal sets that have a document: cls (any unique number), least (doc_id, t), regs."""
    bands, rows = plan(percent)
    sig = written(docs.select("doc_id", "t", "text").mapInArrow(lambda it: _sketch(it, bands * rows), "doc_id long, t long, n_shingles long, f1 long, f2 long, regs binary"))
    held = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*NAME).agg(F.min(F.struct("doc_id", "t")).alias("least"), F.first("regs").alias("regs"))
    return sig, written(held.withColumn("cls", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links at a similarity of percent/100 or more."""
    docs = _read(docs)
    sig, classes = _classes(docs, percent)
    whole = components(_own_ids(sig, classes).unionByName(_links(docs, classes, percent)))
    named = written(_componented(classes, whole))
    # a component's id is its smallest doc_id
    least = named.groupBy("component").agg(F.min("least.doc_id").alias("component_id"))
    out = sig.select("doc_id", *NAME).join(written(named.join(least, "component").select(*NAME, "component_id")), NAME, "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, percent: int) -> DataFrame:
    """docs with one row of each group: the smallest doc_id, of its texts in the group the one of the smallest hash.

    Rows without a doc_id or without words stay. Alike are texts, whatever doc_id they have.
    """
    read = _read(docs)
    _, classes = _classes(read, percent)
    named = _componented(classes, components(_links(read, classes, percent)))
    kept = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("__id"), F.col("least.t").alias("__t"))
    here = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__t": F.xxhash64(F.col("text").cast("string"))})
    free = F.col("__id").isNull() | ~F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = here.filter(~free).join(kept, ["__id", "__t"], "left_semi").dropDuplicates(["__id", "__t"])
    return one.unionByName(here.filter(free)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _componented(classes: DataFrame, whole: DataFrame) -> DataFrame:
    return classes.drop("regs").join(whole, F.col("cls") == F.col("id"), "left").select(*NAME, "least", F.coalesce("component", "cls").alias("component"))


def _own_ids(sig: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between classes that share a document, which needs two texts under one doc_id."""
    ids = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", *NAME).distinct()
    twice = ids.join(ids.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "doc_id", "left_semi")
    named = written(twice.join(classes.select(*NAME, "cls"), NAME).select("doc_id", "cls"))
    return named.join(named.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").select("a", F.col("cls").alias("b"))


def _links(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    bands, rows = plan(percent)
    sized = classes.select("cls", F.col("n_shingles").alias("n"), "regs")
    banded = sized.mapInArrow(lambda it: _band_rows(it, bands, rows), "key long, cls long, n long")
    hubs = banded.groupBy("key").agg(F.min("cls").alias("hub"), F.count("*").alias("many")).filter("many > 1").select("key", "hub")
    star = written(banded.join(written(hubs), "key").filter("cls <> hub").select(F.col("hub").alias("a"), F.col("cls").alias("b")).distinct())
    # classes are unique as written, so that adaptive execution can split a hub's rows
    side = lambda x: sized.select(F.col("cls").alias(x), F.col("n").alias("n_" + x), F.col("regs").alias("regs_" + x))
    met = star.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    tried = written(met.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(lambda it: _likely(it, percent), "a long, b long"))
    clumps = written(components(star))
    sets = _sets_of(docs, classes, clumps.select("id"))
    links = _confirmed(sets, tried, percent)
    sized_clumps = clumps.withColumnRenamed("component", "clump").join(classes.select(F.col("cls").alias("id"), F.col("n_shingles").alias("n")), "id")
    return links.unionByName(_across(sets, sized_clumps, components(links), percent))


def _across(sets: DataFrame, clumps: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links between components of one clump: classes outside its largest component against all of it that their sizes admit.

    clumps: id, clump, n. Sizes fall into bands such that alike sets are in one band or in neighbouring ones.
    """
    member = written(clumps.join(linked, "id", "left").select("id", "clump", "n", F.coalesce("component", "id").alias("comp")))
    count = member.groupBy("clump", "comp").agg(F.count("*").alias("many"))
    top = count.groupBy("clump").agg(F.max(F.struct("many", F.col("comp").alias("main"))).alias("top"), F.count("*").alias("comps"))
    open_ = member.join(written(top.filter("comps > 1").select("clump", "top.main")), "clump")
    open_ = open_.withColumn("band", F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int"))
    names = ["clump", "band", "id", "comp", "n", "side"]
    inner = open_.withColumn("side", F.lit(0)).select(*names)
    outer = open_.filter("comp <> main").withColumn("side", F.lit(1)).withColumn("band", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)))
    both = written(inner.unionByName(outer.select(*names)))
    blocks = lambda side, most: F.greatest(F.ceil(F.count_if(F.col("side") == side) / most), F.ceil(F.sum(F.when(F.col("side") == side, 8 * F.col("n"))) / BLOCK_BYTES)).cast("int")
    shape = written(both.groupBy("clump", "band").agg(blocks(0, INSIDE).alias("ins"), blocks(1, OUTSIDE).alias("outs")).filter("ins > 0 AND outs > 0"))
    at = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(parts)).cast("int")
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    own = F.when(F.col("side") == 0, at("ins", 1)).otherwise(at("outs", 2))
    met = F.explode(F.when(F.col("side") == 0, every("outs")).otherwise(every("ins")))
    dealt = both.join(shape, ["clump", "band"]).select("clump", "band", "side", "id", "comp", "n", own.alias("own"), met.alias("met"))
    cell = ["clump", "band", "outside", "inside"]
    is_in = F.col("side") == 0
    dealt = written(dealt.withColumns({"outside": F.when(is_in, F.col("met")).otherwise(F.col("own")), "inside": F.when(is_in, F.col("own")).otherwise(F.col("met"))}).drop("own", "met"))
    tasks = max(1, (dealt.agg(F.sum(8 * F.col("n"))).first()[0] or 0) // TASK_BYTES)
    full = dealt.withColumn("task", F.pmod(F.xxhash64(*cell), F.lit(tasks)).cast("int")).join(sets, "id").select("task", *cell, "side", "id", "comp", "shingles")
    return written(full.groupBy("task").applyInArrow(lambda t: _compare(t, percent), "a long, b long").distinct())


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """One task's blocks: a link from each outsider to one class of each other component it is like."""
    frame = table.drop_columns(["shingles"]).to_pandas()
    sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
    size = np.array([len(s) for s in sets])
    found: set[tuple[int, int]] = set()
    for _, part in frame.groupby(["clump", "band", "outside", "inside"], sort=True):
        rows = part.index.to_numpy()
        inner, outer = rows[part["side"].to_numpy() == 0], rows[part["side"].to_numpy() == 1]
        if not len(inner) or not len(outer):
            continue
        flat = np.concatenate([sets[i] for i in inner])
        kinds, number = np.unique(flat, return_inverse=True)
        starts = np.cumsum(size[inner]) - size[inner]
        here, comp, ids = np.zeros(len(kinds), bool), frame["comp"].to_numpy(), frame["id"].to_numpy()
        for o in outer.tolist():
            at = np.minimum(np.searchsorted(kinds, sets[o]), len(kinds) - 1)
            at = at[kinds[at] == sets[o]]
            here[at] = True
            both = np.add.reduceat(here[number].astype(np.int32), starts)
            here[at] = False
            like = (both > 0) & (100 * both >= percent * (size[inner] + size[o] - both)) & (comp[inner] != comp[o])
            _, first = np.unique(comp[inner[like]], return_index=True)
            found.update((int(ids[o]), int(ids[i])) for i in inner[like][first])
    a, b = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
