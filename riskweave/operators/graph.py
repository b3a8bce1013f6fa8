"""The account graph: edges from transfers and shared attributes, and features of accounts.

Edges are one table src < dst with weight, tx_count and shared_attrs. Every algorithm is
joins and aggregations over it; steps of a loop are written tables. Louvain communities of
small components are a task each, those of large ones are joins; betweenness takes some start
accounts of a component a task, those of the same links as one.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.scalar import safe_div, steady_sum
from riskweave.operators.components import components
from riskweave.sources.scratch import written

ATTRIBUTES = ("device_id", "ip_address", "phone", "email")
#: Accounts of a block, pairs of a task, neighbours of a list's part.
SIDE, TASK_PAIRS, PART = 128, 30_000, 100_000
#: Edges of a component that one task takes for Louvain's moves; start accounts of a task for betweenness.
TASK_EDGES, SOURCES = 2_000_000, 250
#: Betweenness: partitions that tasks are dealt to at most, links followed from several starts at a time, the weight up to which a link ties no twins.
MOST_TASKS, LEVEL_LINKS, SHORT = 2000, 2_000_000, 1e-9


def transfer_edges(df: DataFrame, account: str = "account_id", other: str = "counterparty_account_id") -> DataFrame:
    """Undirected transfers: weight is the sum of amounts, whatever their order, tx_count their number."""
    pairs = df.select(F.col(account).alias("a"), F.col(other).alias("b"), "amount").dropna(subset=["a", "b"]).filter("a <> b")
    pairs = pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
    return pairs.agg(steady_sum(F.col("amount")).alias("weight"), F.count("*").cast("double").alias("tx_count"))


def shared_attribute_pairs(df: DataFrame, account: str = "account_id", attributes: tuple[str, ...] = ATTRIBUTES, largest: int = 50) -> DataFrame:
    """src, dst, shared_attrs: how many attribute values two accounts share; larger groups than `largest` tie nobody."""
    present = [a for a in attributes if a in df.columns]
    if not present:
        return df.sparkSession.createDataFrame([], "src string, dst string, shared_attrs double")
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.col(a).cast("string").alias("value")) for a in present]))
    seen = df.filter(F.col(account).isNotNull()).select(F.col(account).alias("id"), named.alias("x")).select("id", "x.*")
    seen = seen.filter(F.col("value").isNotNull()).distinct()
    # the size limit comes before the self-join, whose output is therefore bounded a group
    sizes = seen.groupBy("kind", "value").count().filter(F.col("count").between(2, largest)).select("kind", "value")
    seen = seen.join(sizes, ["kind", "value"])
    pairs = seen.withColumnRenamed("id", "src").join(seen.withColumnRenamed("id", "dst"), ["kind", "value"]).filter("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("shared_attrs"))


def account_edges(df: DataFrame, account: str = "account_id", other: str = "counterparty_account_id", attributes: tuple[str, ...] = ATTRIBUTES, largest: int = 50) -> DataFrame:
    """Transfers and shared attributes as one edge table; a shared value adds 1 to the weight."""
    zero = F.lit(0.0)
    transfers = transfer_edges(df, account, other).withColumn("shared_attrs", zero) if other in df.columns else None
    shared = shared_attribute_pairs(df, account, attributes, largest).select("src", "dst", F.col("shared_attrs").alias("weight"), zero.alias("tx_count"), "shared_attrs")
    both = transfers.unionByName(shared) if transfers is not None else shared
    return both.groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in ("weight", "tx_count", "shared_attrs")])


def vertices(df: DataFrame, edges: DataFrame, account: str = "account_id") -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return df.select(F.col(account).alias("id")).dropna().unionByName(ends).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("graph_degree"), F.sum("weight").alias("graph_weighted_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, steps: int = 100, tol: float | None = 1e-6, cut_every: int = 5) -> DataFrame:
    """id, graph_pagerank. With tol it stops once the total change is under tol a node, else after exactly `steps`."""
    n = nodes.count()
    if not n:
        return nodes.withColumn("graph_pagerank", F.lit(0.0))
    e = both_ways(edges)
    e = written(e.join(e.groupBy("src").agg(F.sum("weight").alias("total")), "src").filter("total <> 0").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    ends = e.select(F.col("src").alias("id")).distinct().withColumn("linked", F.lit(1))
    rank = written(nodes.join(ends, "id", "left").select("id", F.lit(1.0 / n).alias("x"), F.coalesce("linked", F.lit(0)).alias("linked")))
    for step in range(steps):
        given = e.join(rank.select(F.col("id").alias("src"), "x"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("x")).alias("got"))
        idle = rank.agg(F.coalesce(F.sum(F.when(F.col("linked") == 0, F.col("x"))), F.lit(0.0)).alias("idle"))
        new = rank.join(given, "id", "left").crossJoin(F.broadcast(idle))
        new = new.select("id", F.col("x").alias("old"), (alpha * (F.coalesce("got", F.lit(0.0)) + F.col("idle") / n) + (1 - alpha) / n).alias("x"), "linked")
        if tol is not None or step % cut_every == cut_every - 1:
            new = written(new)
        rank = new.drop("old")
        if tol is not None and new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tol:
            break
    return rank.select("id", F.col("x").alias("graph_pagerank"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) and graph_component_size."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    whole = written(nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    return whole.join(whole.groupBy("component").agg(F.count("*").cast("double").alias("graph_component_size")), "component").select("id", "component", "graph_component_size")


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: ends (id, v) with a number for each account, and edges as (a, b, weight) of numbers."""
    ends = written(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("v", F.monotonically_increasing_id()))
    to = lambda name, v: ends.select(F.col("id").alias(name), F.col("v").alias(v))
    return ends, written(edges.select("src", "dst", "weight").join(to("src", "a"), "src").join(to("dst", "b"), "dst").select("a", "b", "weight"))


def _packed(rows: DataFrame, parts: int = 1) -> DataFrame:
    """rows: id, n, w. One row per id and part of its n: both lists, n ascending."""
    part = F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")
    return rows.groupBy("id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("l")).select("id", "part", F.col("l.n").alias("ns"), F.col("l.w").alias("ws"))


def _intersected(pairs: DataFrame, lists: DataFrame, work, schema: str, nodes: int, parts: int = 1) -> DataFrame:
    """work on the pairs (a, b, x) of each task and the lists of their two sides.

    Pairs are dealt by blocks of both ends, so that a list goes to a task once for all pairs
    there; a list's parts are met apart. No pair is multiplied by its neighbours in a shuffle.
    """
    blocks, many = max(1, -(-nodes // SIDE)), pairs.count()
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    task = F.pmod(F.xxhash64(block("a"), block("b"), "part"), F.lit(max(1, -(-many * parts // TASK_PAIRS)))).cast("int")
    dealt = written(pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("task", task))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ns", "array<long>"), ("ws", "array<double>"))]
    rows = dealt.select("task", "part", F.lit(2).alias("side"), "a", "b", "x", *none)
    for side, end in enumerate("ab"):
        own = dealt.select("task", "part", F.col(end).alias("id")).distinct().join(lists, ["id", "part"])
        rows = rows.unionByName(own.select("task", "part", F.lit(side).alias("side"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("x"), "ns", "ws"))
    return rows.groupBy("task").applyInArrow(lambda t: pa.concat_tables([work(*_sides(p)) for p in _by_part(t)]), schema)


def _by_part(t: pa.Table):
    part = t["part"].to_numpy()
    for p in np.unique(part):
        yield t.filter(pa.array(part == p)).combine_chunks()


def _sides(t: pa.Table):
    """Pairs in order of a, and for both sides: ascending ids, list bounds, flat numbers and weights."""
    side = t["side"].to_numpy()
    out = []
    for k in (0, 1):
        mine = t.filter(pa.array(side == k))
        order = np.argsort(mine["a"].to_numpy(), kind="stable")
        mine = mine.take(pa.array(order)).combine_chunks()
        ns, ws = (mine[c].chunk(0) if len(mine) else pa.array([], pa.list_(kind)) for c, kind in (("ns", pa.int64()), ("ws", pa.float64())))
        bounds = np.concatenate([[0], np.cumsum(np.asarray(ns.value_lengths(), np.int64))])
        out.append((mine["a"].to_numpy(), bounds, ns.flatten().to_numpy(), ws.flatten().to_numpy()))
    pairs = t.filter(pa.array(side == 2))
    a, b, x = (pairs[c].to_numpy() for c in "abx")
    order = np.argsort(a, kind="stable")
    return a[order], b[order], x[order], *out


def _met(a: np.ndarray, b: np.ndarray, left: tuple, right: tuple):
    """For each a: its pairs with a list on both sides, then for all their right lists the flat places, left weights there, pair of each."""
    kinds, number = np.unique(np.concatenate([left[2], right[2]]), return_inverse=True)
    one, two = number[: len(left[2])], number[len(left[2]) :]
    value = np.zeros(len(kinds))
    cut = np.append(np.flatnonzero(np.diff(a, prepend=a[:1] - 1)), len(a)) if len(a) else np.zeros(1, np.int64)
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        at = np.searchsorted(left[0], a[i])
        if at == len(left[0]) or left[0][at] != a[i]:
            continue
        theirs = np.minimum(np.searchsorted(right[0], b[i:j]), max(len(right[0]) - 1, 0))
        ok = right[0][theirs] == b[i:j] if len(right[0]) else np.zeros(j - i, bool)
        theirs, rows = theirs[ok], np.arange(i, j)[ok]
        if not len(rows):
            continue
        mine = slice(left[1][at], left[1][at + 1])
        value[one[mine]] = left[3][mine]
        size = right[1][theirs + 1] - right[1][theirs]
        first = np.cumsum(size) - size
        flat = np.arange(size.sum()) + np.repeat(right[1][theirs] - first, size)
        yield rows, first, size, two[flat], value[two[flat]], right[3][flat], kinds
        value[one[mine]] = 0.0


def _triangles(a, b, x, left, right) -> pa.Table:
    """Sums of x * left weight * right weight over common neighbours, for all three corners."""
    ids, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
    third = kinds = None
    for rows, first, size, where, one, two, kinds in _met(a, b, left, right):
        third = np.zeros(len(kinds)) if third is None else third
        each = one * two * np.repeat(x[rows], size)
        got = np.add.reduceat(each, first)
        ids += [a[rows], b[rows]]
        sums += [got, got]
        third += np.bincount(where, each, len(kinds))
    if third is not None:
        ids.append(kinds)
        sums.append(third)
    known, number = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(number, np.concatenate(sums), len(known)) if len(known) else np.zeros(0)
    return pa.table({"v": pa.array(known, pa.int64()), "t": pa.array(total, pa.float64())})


def _common(a, b, x, left, right) -> pa.Table:
    """a, b and the number of common neighbours of each pair that has one."""
    out = [(rows, np.add.reduceat((one > 0).astype(float), first)) for rows, first, _, _, one, _, _ in _met(a, b, left, right)]
    rows = np.concatenate([r for r, _ in out]) if out else np.zeros(0, np.int64)
    n = np.concatenate([n for _, n in out]) if out else np.zeros(0)
    return pa.table({"a": pa.array(a[rows], pa.int64()), "b": pa.array(b[rows], pa.int64()), "n": pa.array(n, pa.float64())})


def clustering(edges: DataFrame) -> DataFrame:
    """id, graph_clustering: weighted clustering of accounts with an edge.

    Edges point from the smaller degree to the larger, so no account has more than the root of
    twice the edges ahead of it. The cube root of a triangle's weights is the product of the
    edges' own, so triangles are summed where an edge's two lists of accounts ahead meet.
    """
    edges = written(edges)
    top = edges.agg(F.max("weight")).first()[0] or 1.0
    ends, e = numbered(edges)
    deg = written(e.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("graph_degree")))
    of = lambda end: deg.select(F.col("v").alias(end), F.struct(F.col("graph_degree").alias("d"), F.col("v")).alias("o_" + end))
    e = e.withColumn("x", F.cbrt(F.col("weight") / top)).join(of("a"), "a").join(of("b"), "b")
    low = F.col("o_a") < F.col("o_b")
    e = written(e.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), "x"))
    ahead = written(_packed(e.select(F.col("a").alias("id"), F.col("b").alias("n"), F.col("x").alias("w"))))
    per = _intersected(e, ahead, _triangles, "v long, t double", deg.count()).groupBy("v").agg(F.sum("t").alias("t"))
    pairs = F.col("graph_degree") * (F.col("graph_degree") - 1)
    whole = deg.join(per, "v", "left").select("v", safe_div(2 * F.coalesce("t", F.lit(0.0)), pairs).alias("graph_clustering"))
    return ends.join(whole, "v").select("id", "graph_clustering")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, community: majority label of the neighbours, the current one if it is among the largest, else the smallest."""
    e = both_ways(edges).select("src", "dst")
    now = nodes.select("id", F.col("id").alias("community"))
    for _ in range(rounds):
        votes = e.join(now.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").count()
        best = votes.groupBy("id").agg(F.max("count").alias("most"))
        tops = votes.join(best, "id").filter("count = most").groupBy("id").agg(F.min("community").alias("least"), F.collect_set("community").alias("tops"))
        new = now.join(tops, "id", "left").withColumn("new", F.when(F.col("tops").isNull() | F.array_contains("tops", F.col("community")), F.col("community")).otherwise(F.col("least")))
        new = written(new.select("id", "community", "new"))
        moved = new.filter("community <> new").limit(1).count()
        now = new.select("id", F.col("new").alias("community"))
        if not moved:
            break
    return now


def _louvain(links: dict, weight_of_all: float) -> dict:
    """Communities of one component: node to smallest member, by repeated local moves and merging."""
    home = {v: v for v in links}
    graph = {v: dict(ns) for v, ns in links.items()}
    while True:
        degree = {v: sum(ns.values()) + ns.get(v, 0.0) for v, ns in graph.items()}
        group, total = {v: v for v in graph}, dict(degree)
        moved_any, moved = False, True
        while moved:
            moved = False
            for v in sorted(graph):
                to = defaultdict(float)
                for u, w in graph[v].items():
                    if u != v:
                        to[group[u]] += w
                old = group[v]
                total[old] -= degree[v]
                gain = lambda c: to.get(c, 0.0) - degree[v] * total[c] / (2 * weight_of_all)  # noqa: B023, E731
                best = min((c for c in {*to, old}), key=lambda c: (-gain(c), c))
                if gain(best) <= gain(old) + 1e-12:
                    best = old
                total[best] += degree[v]
                if best != old:
                    group[v], moved, moved_any = best, True, True
        if not moved_any:
            return home
        home = {v: group[c] for v, c in home.items()}
        merged: dict = {c: defaultdict(float) for c in set(group.values())}
        for v, ns in graph.items():
            for u, w in ns.items():
                if u == v:
                    merged[group[v]][group[v]] += w
                elif group[u] == group[v]:
                    merged[group[v]][group[v]] += w / 2
                else:
                    merged[group[v]][group[u]] += w
        graph = {v: dict(ns) for v, ns in merged.items()}


def _links(pdf: pd.DataFrame) -> dict:
    links: dict = defaultdict(dict)
    for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"], strict=True):
        links[a][b] = links[b][a] = float(w)
    return links


def _component_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their component, and each component's numbers of nodes and edges."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    inside = written(edges.select("src", "dst", "weight").join(found.withColumnRenamed("id", "src"), "src"))
    size = found.groupBy("component").agg(F.count("*").alias("nodes")).join(inside.groupBy("component").agg(F.count("*").alias("edges")), "component")
    return inside, written(size)


def louvain(nodes: DataFrame, edges: DataFrame, largest: int = TASK_EDGES) -> DataFrame:
    """id, community (its smallest member), by Louvain's local moves and merging.

    Communities never span components. A component of at most `largest` edges is one task that
    moves accounts one after another; in a larger one half of the accounts move at a time, by
    joins, until the modularity of a level stops rising. Both are Louvain's method, but the
    order of moves differs, and so may communities.
    """
    inside, size = _component_edges(edges)
    weight = float(inside.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]) or 1.0

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        home = _louvain(_links(pdf), weight)
        least: dict = {}
        for v, c in home.items():
            least[c] = min(least.get(c, v), v)
        return pd.DataFrame({"id": list(home), "community": [least[c] for c in home.values()]})

    few = inside.join(size.filter(F.col("edges") <= largest).select("component"), "component", "left_semi")
    found = few.groupBy("component").applyInPandas(work, "id string, community string")
    many = written(inside.join(size.filter(F.col("edges") > largest).select("component"), "component", "left_semi"))
    if not many.isEmpty():
        found = found.unionByName(_louvain_by_joins(many.select("src", "dst", "weight"), weight))
    found = written(found)
    return nodes.join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def _louvain_by_joins(edges: DataFrame, weight: float) -> DataFrame:
    """id, community: levels of local moves, half of the accounts at a time, each followed by merging."""
    e = written(both_ways(edges).select("src", "dst", F.col("weight").alias("w")))  # a loop of a merged account holds both directions
    home = written(e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id")))
    while True:
        now = _moved(e, weight)
        if now is None:
            break
        home = written(home.join(now.select(F.col("id").alias("community"), F.col("community").alias("to")), "community").select("id", F.col("to").alias("community")))
        end = lambda c: now.select(F.col("id").alias(c), F.col("community").alias("to_" + c))  # noqa: B023, E731
        e = written(e.join(end("src"), "src").join(end("dst"), "dst").groupBy(F.col("to_src").alias("src"), F.col("to_dst").alias("dst")).agg(F.sum("w").alias("w")))
    least = home.groupBy("community").agg(F.min("id").alias("least"))
    return home.join(least, "community").select("id", F.col("least").alias("community"))


def _moved(e: DataFrame, weight: float, rise: float = 1e-6, patience: int = 4) -> DataFrame | None:
    """One level: id, community of the highest modularity met, or None if no move raised it."""
    degree = written(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")))
    apart = e.filter("src <> dst")
    now = degree.withColumn("community", F.col("id"))

    def modularity(now: DataFrame) -> float:
        to = now.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
        inner = e.join(now.select(F.col("id").alias("src"), "community"), "src").join(to, "dst").filter("community = c2").agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
        total = now.groupBy("community").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
        return inner / (2 * weight) - total / (4 * weight * weight)

    start = top = modularity(now)
    best, idle, turn = None, 0, 0
    while idle < patience:
        total = now.groupBy("community").agg(F.sum("k").alias("t"))
        to = apart.join(now.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        own = now.select("id", "k", F.col("community").alias("own"))
        to = to.unionByName(now.select("id", "community", F.lit(0.0).alias("w"))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        tried = to.join(own, "id").join(total, "community").withColumn("rest", F.col("t") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0))
        tried = tried.withColumn("gain", F.col("w") - F.col("k") * F.col("rest") / (2 * weight))
        stay = F.max(F.when(F.col("community") == F.col("own"), F.col("gain")))
        pick = tried.groupBy("id").agg(F.first("k").alias("k"), F.first("own").alias("own"), stay.alias("stay"), F.max("gain").alias("most"), F.max_by(F.col("community"), F.struct("gain", "community")).alias("to"))
        goes = (F.col("most") > F.col("stay") + 1e-12) & (F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(2)) == 0)
        now = written(pick.select("id", "k", F.when(goes, F.col("to")).otherwise(F.col("own")).alias("community")))
        value = modularity(now)
        best, idle = (now, 0 if value > top + rise else idle + 1) if value > top else (best, idle + 1)
        top, turn = max(top, value), turn + 1
    return best if top > start + rise else None


def betweenness(nodes: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """id, graph_betweenness: the share of shortest paths through an account, the weight as distance.

    Exact: accounts with the same links count as one start and one stop, with their number. A task
    takes SOURCES such starts of one component with the links between them, which it must hold.
    Of several edges between two accounts the shortest counts. With a limit all are 0 in a table
    of more accounts than that (the settings' betweenness_limit).
    """
    n = nodes.count()
    zero = nodes.withColumn("graph_betweenness", F.lit(0.0))
    if n < 3 or (limit is not None and n > limit):
        return zero

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, ends = np.unique(np.concatenate([pdf["src"], pdf["dst"]]), return_inverse=True)
        many = np.ones(len(ids))
        many[ends] = np.concatenate([pdf["src_many"], pdf["dst_many"]])
        starts, weights = np.arange(key[1], len(ids), pdf["chunks"].iloc[0]), pdf["weight"].to_numpy()
        a, b = np.split(ends, 2)
        if weights.max() == weights.min() > SHORT:
            score = _paths_by_levels(a, b, many, starts)
        else:
            score = _paths_through(a.tolist(), b.tolist(), weights.tolist(), many.tolist(), starts.tolist())
        return pd.DataFrame({"twin": ids, "b": score / ((n - 1) * (n - 2))})

    twins, links = _twins(edges)
    inside, size = _component_edges(links)
    size = size.select("component", F.ceil(F.col("nodes") / SOURCES).cast("int").alias("chunks"))
    dealt = inside.join(size, "component").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    many = twins.groupBy("twin").agg(F.count("*").cast("double").alias("many"))
    for end in ("src", "dst"):
        dealt = dealt.join(many.select(F.col("twin").alias(end), F.col("many").alias(f"{end}_many")), end)
    tasks = size.agg(F.coalesce(F.sum("chunks"), F.lit(1))).first()[0]  # few rows, much work: not to be put together
    dealt = dealt.repartition(min(tasks, MOST_TASKS), "component", "chunk")
    found = dealt.groupBy("component", "chunk").applyInPandas(work, "twin long, b double").groupBy("twin").agg(F.sum("b").alias("b"))
    found = twins.join(found, "twin").select("id", "b")
    return nodes.join(found, "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("graph_betweenness"))


def _twins(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables: ends (id, twin), the twin a number shared by accounts of the same neighbours
    at the same weights; and one of the equal links between two twins (src, dst, weight).

    Such accounts are candidates by two hashes of their links, which are then compared. A link of
    SHORT or less leaves its ends apart: there paths could run through several twins.
    """
    ends, e = numbered(edges)
    e = e.filter("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("weight").alias("weight"))
    e = written(e)
    links = both_ways(e)
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "dst", "weight")).alias(f"h{k}") for k in (1, 2)]
    alike = written(links.groupBy("src").agg(F.count("*").alias("d"), F.min("weight").alias("least"), *marks).filter(F.col("least") > SHORT))
    by = ["d", "h1", "h2"]
    group = alike.groupBy(*by).agg(F.min("src").alias("twin"), F.count("*").alias("all")).filter(F.col("all") > 1)
    tried = written(alike.join(group, by).filter("src <> twin").select("twin", "d", "src"))
    theirs = links.select(F.col("src").alias("twin"), "dst", "weight")
    same = links.join(tried, "src").join(theirs, ["twin", "dst", "weight"]).groupBy("src", "twin", "d").count().filter("count = d")
    same = written(same.select(F.col("src").alias("v"), "twin"))
    ends = written(ends.join(same, "v", "left").select("id", F.coalesce("twin", "v").alias("twin")))
    for end in ("src", "dst"):
        e = e.join(same.select(F.col("v").alias(end)), end, "left_anti")
    return ends, written(e.select("src", "dst", "weight"))


def _paths_by_levels(a: np.ndarray, b: np.ndarray, many: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """_paths_through where all links are of one length: the next level of many starts at a time."""
    n, order = len(many), np.argsort(np.concatenate([a, b]), kind="stable")
    to, degree = np.concatenate([b, a])[order], np.bincount(np.concatenate([a, b]), minlength=n)
    first = np.cumsum(degree) - degree

    def linked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place's position in `at`, repeated, and the places of the same start linked with it."""
        v = at % n
        d = degree[v]
        whose = np.repeat(np.arange(len(at)), d)
        step = np.arange(len(whose)) - np.repeat(np.cumsum(d) - d, d)
        return whose, (at - v)[whose] + to[first[v][whose] + step]

    score, side = np.zeros(n), max(1, LEVEL_LINKS // len(to))
    for k in range(0, len(starts), side):
        s = starts[k : k + side]
        here = np.arange(len(s)) * n + s
        count = np.tile(many, len(s))
        count[here] -= 1  # the start's twins are places to go to, if it has any
        fresh, ways, last = count > 0, np.zeros(len(count)), np.zeros(len(count), np.int64)
        _, at = linked(here)
        fresh[at], ways[at] = False, 1.0
        steps = []
        while len(at):
            whose, nxt = linked(at)
            new = fresh[nxt]
            past, nxt = at[whose[new]], nxt[new]
            np.add.at(ways, nxt, ways[past] * count[past])
            fresh[nxt], last[nxt] = False, np.arange(len(nxt))
            steps.append((past, nxt))
            at = nxt[last[nxt] == np.arange(len(nxt))]
        back = np.zeros(len(count))
        for past, nxt in reversed(steps):
            np.add.at(back, past, count[nxt] * ways[past] / ways[nxt] * (1 + back[nxt]))
        score += many[s] @ back.reshape(len(s), n)
    return score


def _paths_through(a: list, b: list, weights: list, many: list, starts: list) -> np.ndarray:
    """How many shortest paths from the starts, and from the others they stand for, pass one of each node, equal ones shared."""
    links: list[list] = [[] for _ in many]
    for u, v, w in zip(a, b, weights, strict=True):
        links[u].append((v, w))
        links[v].append((u, w))
    score = np.zeros(len(many))
    for s in starts:
        count = many.copy()
        count[s] -= 1  # the start's twins are a node to go to, if it has any
        dist, ways, before = dict(links[s]), {u: 1.0 for u, _ in links[s]}, defaultdict(list)
        heap, done, seen = [(w, u) for u, w in links[s]], [], set() if count[s] else {s}
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            done.append(v)
            for u, w in links[v]:
                if u in seen:
                    continue
                if u not in dist or d + w < dist[u] - 1e-12:
                    dist[u], ways[u], before[u] = d + w, ways[v] * count[v], [v]
                    heapq.heappush(heap, (d + w, u))
                elif abs(d + w - dist[u]) <= 1e-12:
                    ways[u] += ways[v] * count[v]
                    before[u].append(v)
        back = defaultdict(float)
        for v in reversed(done):
            for u in before[v]:
                back[u] += count[v] * ways[u] / ways[v] * (1 + back[v])
            score[v] += many[s] * back[v]
    return score


def community_risk(members: DataFrame, df: DataFrame, account: str = "account_id", label: str = "label") -> DataFrame:
    """id, community and community_risk: the mean label of the community's accounts, 0 for one without a label."""
    fraud = df.groupBy(F.col(account).alias("id")).agg(F.max(label).alias("bad"))
    marked = members.join(fraud, "id", "left").select("id", "community", F.coalesce("bad", F.lit(0)).cast("double").alias("bad"))
    return marked.join(marked.groupBy("community").agg(F.avg("bad").alias("community_risk")), "community").select("id", "community", "community_risk")


def account_features(df: DataFrame, edges: DataFrame, members: DataFrame | None = None, steps: int = 100, tol: float | None = 1e-6, betweenness_limit: int | None = None) -> DataFrame:
    """One row per account with all graph features."""
    edges = written(edges)
    nodes = written(vertices(df, edges))
    members = louvain(nodes, edges) if members is None else members
    out = nodes.join(degrees(edges), "id", "left").join(pagerank(nodes, edges, steps=steps, tol=tol), "id").join(clustering(edges), "id", "left")
    out = out.join(component_sizes(nodes, edges), "id").join(betweenness(nodes, edges, betweenness_limit), "id").join(community_risk(members, df), "id", "left")
    return out.fillna(0.0, ["graph_degree", "graph_weighted_degree", "graph_clustering", "community_risk"])


def attach_features(df: DataFrame, features: DataFrame, account: str = "account_id") -> DataFrame:
    """Transactions with their account's graph features; unknown accounts get the defaults, the mean risk among them."""
    mean = features.agg(F.coalesce(F.avg("community_risk"), F.lit(0.0)).alias("__mean"))
    defaults = {"graph_degree": 0.0, "graph_weighted_degree": 0.0, "graph_pagerank": 0.0, "graph_betweenness": 0.0, "graph_clustering": 0.0, "graph_component_size": 1.0}
    names = [c for c in defaults if c in features.columns]
    own = features.select(F.col("id").alias("__id"), *names, "community_risk", F.lit(1).alias("__known"))
    out = df.drop(*names, "community_risk").join(own, F.col(account) == F.col("__id"), "left").crossJoin(F.broadcast(mean))
    out = out.withColumns({c: F.coalesce(c, F.lit(defaults[c])) for c in names} | {"community_risk": F.coalesce("community_risk", "__mean")})
    return out.drop("__id", "__known", "__mean")


def link_features(df: DataFrame, edges: DataFrame, account: str = "account_id", other: str = "counterparty_account_id") -> DataFrame:
    """df with common_neighbors and jaccard_similarity of the row's two accounts; 0 if either is unknown.

    Each pair meets the two lists of neighbours, in parts where a hub's list is long.
    """
    ends, e = numbered(edges)
    twoway = e.select(F.col("a").alias("id"), F.col("b").alias("n")).unionAll(e.select(F.col("b").alias("id"), F.col("a").alias("n"))).withColumn("w", F.lit(1.0))
    deg = written(twoway.groupBy("id").agg(F.count("*").cast("double").alias("d")))
    most, nodes = deg.agg(F.coalesce(F.max("d"), F.lit(0.0)), F.count("*")).first()
    parts = max(1, -(-int(most) // PART))
    of = lambda name, v: ends.select(F.col("id").alias(name), F.col("v").alias(v))
    pairs = df.select(F.col(account).alias("__a"), F.col(other).alias("__b")).dropna().distinct()
    pairs = written(pairs.join(of("__a", "a"), "__a").join(of("__b", "b"), "__b"))
    lists = written(_packed(twoway, parts))
    met = _intersected(pairs.select("a", "b", F.lit(1.0).alias("x")), lists, _common, "a long, b long, n double", nodes, parts)
    common = met.groupBy("a", "b").agg(F.sum("n").alias("common_neighbors")).filter("common_neighbors > 0")
    sized = common.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b").join(pairs, ["a", "b"])
    sized = sized.select("__a", "__b", "common_neighbors", safe_div(F.col("common_neighbors"), F.col("da") + F.col("db") - F.col("common_neighbors")).alias("jaccard_similarity"))
    out = df.join(sized, (F.col(account) == F.col("__a")) & (F.col(other) == F.col("__b")), "left").drop("__a", "__b")
    return out.fillna(0.0, ["common_neighbors", "jaccard_similarity"])


def top_neighbors(edges: DataFrame, n: int = 10) -> DataFrame:
    """The n heaviest neighbours of every account: id, rank, account_id, weight, tx_count, shared_attrs.

    Equal weights rank by account_id; transfers of equal amounts in another order weigh the same.
    """
    from pyspark.sql import Window

    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("account_id"), "weight", "tx_count", "shared_attrs")
    both = both.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("account_id"), "weight", "tx_count", "shared_attrs"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "account_id"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= n)
