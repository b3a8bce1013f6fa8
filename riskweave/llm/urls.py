"""URL filter: explicit rules first, then a path-template tree per host.

Path segments are shaped first (runs of digits, hexadecimal and long tokens become marks);
shapes are counted per host and read segment by segment into a tree. At a node, children
seen on at most RARE pages each become one wildcard branch if there are MANY of them: the
segment varies. Of the other children, those with labelled pages whose share of bad ones
doesn't differ from the node's (by more than two standard errors) are alike; two or more of
them merge into the wildcard too, a single one keeps its name. A path ends at its own node:
it shares a template with paths of as many segments only. Nodes without a choice are passed
at once, so rounds follow the branchings, not the segments, and every segment is read.

A template is rejected when its smoothed share of bad labelled pages reaches PURITY. It is
smoothed by PRIOR pages of its host's share, that by as many of the overall share, and that by
as many good pages: at an overall share of a quarter, four labelled pages, all bad, reject.
Labelled pages are those whose page_id has a row in `labels` with that doc_id: bad if toxic
or of quality 0.

All of it is aggregation of small summaries (map-side combined, so a host with a third of
all pages is no hot task) and equi joins of written tables, which adaptive execution can
split. Urls of any length are read whole.

Nulls: a null url, or one without `://`, has an empty host and path and is judged like any
other. Null labels and ids label nothing; repeated labels of a page count once, bad if any
is. Rows are judged alone, so repeated rows repeat. Other columns, whatever their names, are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import written

#: Verdict, host and path of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rare children that make a segment variable, and the pages up to which a child is rare.
MANY, RARE = 8, 4
#: Pseudo-counts of the smoothing, and the share of bad pages that rejects a template.
PRIOR, PURITY = 10.0, 0.6


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host, path), as text and verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def shape(path: str = "path") -> Column:
    """The path with tokens that vary by page replaced by marks."""
    c = F.regexp_replace(F.col(path), r"[0-9a-f]{8,}", "{x}")
    c = F.regexp_replace(c, r"[A-Za-z0-9_-]{24,}", "{s}")
    return F.regexp_replace(c, r"[0-9]+", "{n}")


def _passed(tree: DataFrame) -> DataFrame:
    """tree past the segments that all rows of a node share, with alone: whether the node has this row only."""
    rest = F.slice("segs", F.col("read") + 1, F.greatest(F.size("segs") - F.col("read"), F.lit(0)))
    tree = tree.withColumn("rest", rest)
    node = tree.groupBy("host", "at").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi"), (F.count("*") == 1).alias("alone"))
    short = F.least(F.size("lo"), F.size("hi"))
    places = F.when(short > 0, F.sequence(F.lit(0), short - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.array_min(F.filter(places, lambda i: F.get("lo", i) != F.get("hi", i)))
    node = node.select("host", "at", "alone", F.coalesce(differ, short).alias("same"))
    step = F.slice("rest", 1, F.col("same"))
    at = F.concat("at", F.when(F.col("same") > 0, F.concat(F.lit("/"), F.array_join(step, "/"))).otherwise(""))
    return written(tree.join(node, ["host", "at"]).withColumns({"at": at, "read": F.col("read") + F.col("same")}).drop("rest", "same"))


def templates(pages: DataFrame) -> DataFrame:
    """pages: host, shape, labelled, bad. One row per host and shape: template and its labelled counts."""
    tree = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum("labelled").alias("lab"), F.sum("bad").alias("bad"))
    tree = written(tree).withColumns({"segs": F.split("shape", "/"), "at": F.lit(""), "read": F.lit(1)})
    done = None
    while True:
        tree = _passed(tree)
        ended = F.col("alone") | (F.col("read") >= F.size("segs"))
        closed = tree.filter(ended).select("host", "shape", "lab", "bad", "at")
        done = closed if done is None else done.unionByName(closed)
        tree = tree.filter(~ended).drop("alone")
        if tree.isEmpty():
            break
        tree = tree.withColumn("child", F.get("segs", F.col("read")))
        kids = written(tree.groupBy("host", "at", "child").agg(F.sum("n").alias("c_n"), F.sum("lab").alias("c_lab"), F.sum("bad").alias("c_bad")))
        node = kids.groupBy("host", "at").agg(F.sum("c_lab").alias("p_lab"), F.sum("c_bad").alias("p_bad"), (F.count_if(F.col("c_n") <= RARE) >= MANY).alias("varies"))
        c_lab, c_bad, p_lab, p_bad = (F.col(c).cast("double") for c in ("c_lab", "c_bad", "p_lab", "p_bad"))
        gap = c_bad * p_lab - p_bad * c_lab
        rare = F.col("varies") & (F.col("c_n") <= RARE)
        alike = ~rare & (c_lab > 0) & (gap * gap <= 4 * p_bad * (p_lab - p_bad) * c_lab)
        judged = written(kids.join(node, ["host", "at"]).select("host", "at", "child", rare.alias("rare"), alike.alias("alike")))
        several = judged.groupBy("host", "at").agg((F.count_if("alike") > 1).alias("several"))
        merged = F.col("rare") | (F.col("alike") & F.col("several"))
        step = judged.join(several, ["host", "at"]).select("host", "at", "child", F.when(merged, "*").otherwise(F.col("child")).alias("to"))
        tree = tree.join(step, ["host", "at", "child"]).withColumns({"at": F.concat("at", F.lit("/"), "to"), "read": F.col("read") + 1}).drop("child", "to")
        # every round reads the one before several times: a written table keeps that from doubling
        tree = written(tree)
    counts = done.groupBy("host", "at").agg(F.sum("lab").alias("t_lab"), F.sum("bad").alias("t_bad"))
    return done.select("host", "shape", "at").join(counts, ["host", "at"]).select("host", "shape", F.col("at").alias("template"), "t_lab", "t_bad")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every page."""
    host, path = host_and_path()
    name, by_rule = rule_of(rules)
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    seen = seen.select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("rule", name).withColumn("by_rule", by_rule).withColumn("shape", shape())
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    marks = labels.filter(F.col("doc_id").isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("page_id")).agg(F.max(bad.cast("long")).alias("is_bad"))
    marked = seen.select("page_id", "host", "shape").join(marks, "page_id", "left")
    marked = marked.select("host", "shape", F.col("is_bad").isNotNull().cast("long").alias("labelled"), F.coalesce("is_bad", F.lit(0)).alias("bad"))
    overall = marked.agg((F.coalesce(F.sum("bad"), F.lit(0)) / (F.coalesce(F.sum("labelled"), F.lit(0)) + PRIOR)).alias("prior"))
    hosts = marked.groupBy("host").agg(F.sum("labelled").alias("h_lab"), F.sum("bad").alias("h_bad")).crossJoin(F.broadcast(overall))
    hosts = hosts.select("host", ((F.col("h_bad") + PRIOR * F.col("prior")) / (F.col("h_lab") + PRIOR)).alias("own"))
    share = (F.col("t_bad") + PRIOR * F.col("own")) / (F.col("t_lab") + PRIOR)
    verdicts = templates(marked).join(written(hosts), "host").select("host", "shape", "template", (share >= PURITY).alias("rejected"))
    verdict = F.coalesce("by_rule", F.when(F.col("rejected"), "block").otherwise("allow"))
    return seen.join(verdicts, ["host", "shape"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
