"""The operators on small tables against brute force, and on the cases their docstrings define."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import forest, langid, mixing, oracles, packing, queries, recompress, rounds, search, secrets, sketch, suffix, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(None if t == "NOID" else first + k, None if t in (None, "NOID") else t, "en", "s", 0, "clash", "clash") for k, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("w%d" % x for x in rng.integers(0, 400, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, copies, repeated rows, long and one-word texts, clashing columns."""
    long = prose(1, 3000)
    near = prose(2, 120)
    rows = [long, None, "", "   \n\t", "NOID", near, near + " extra", near, "one", "a b c d", "A B C D", "é" * 500, "z" * 600, long[3000:9000], " ".join(["ja"] * 60), prose(3, 40)]
    df = docs_of(spark, rows)
    return df.unionByName(df.filter("doc_id = 9"))


def test_oracle_queries_agree(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracles.ORACLES.items():
        want = con.execute(sql).fetchdf()
        got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        rows = lambda d: Counter(tuple(None if v != v else v for v in r) for r in d.astype(object).itertuples(index=False))
        assert rows(got) == rows(want), name


def _colliding(n=1024):
    """Two different words of n letters that any polynomial hash modulo a power of two confuses."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("xy"[b] for b in bits), "".join("yx"[b] for b in bits)


def _wanted_bytes(df):
    texts = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    seen = Counter(t[i : i + 200] for _, t in texts for i in range(len(t) - 199))
    want = Counter()
    for doc, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(doc, len(t), int(gone.sum()), int(spans), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest())] += 1
    return want


def _around(seed, n):
    """Texts with one shared passage of 150 to 330 bytes in differing surroundings, some of them shared too."""
    rng = np.random.default_rng(seed)
    passage = prose(seed, 90)
    sides = [prose(seed + 1 + k, 12) for k in range(9)]
    cut = lambda: passage[: int(rng.integers(150, 330))]
    return [f"{prose(1000 + k, 20)} {sides[rng.integers(9)]} {cut()} {sides[rng.integers(9)]} {prose(5000 + k, 20)}" for k in range(n)]


@pytest.mark.parametrize("hot", [suffix.HOT, 5])
def test_suffix_dedup_against_brute_force(spark, odd, monkeypatch, hot):
    """With hot = 5 the passage's grams are compared by digests; else 150 stretches a gram go through the sort."""
    x, y = _colliding()
    df = odd.unionByName(docs_of(spark, _around(9, 150) + [f"{prose(5, 30)} {x}", f"{prose(6, 30)} {y}", x + x, y], 1000))
    monkeypatch.setattr(rounds, "BLOCK_BYTES", 8_000)
    assert Counter(tuple(r) for r in suffix.deduplicate(df, hot=hot).collect()) == _wanted_bytes(df)


def test_suffix_dedup_of_periodic_runs(spark, monkeypatch):
    """Runs of one byte and of short periods, alone, embedded, side by side at document borders, and up to parts' ends."""
    once = ["a" * n for n in (199, 200)]
    runs = [unit * (n // len(unit)) + unit[: n % len(unit)] for unit in ("b", "xy", "xyx", "12345678", "123456789") for n in (201, 204, 430)]
    within = [f"{prose(k, 25)}{'=' * n}{prose(50 + k, 25)}" for k, n in enumerate((198, 200, 201, 202, 203, 330))]
    mixed = ["=" * 240 + "-" * 240 + "=-" * 150, "-" * 120 + "=" * 120, "", "b" * 150, "b" * 150, "a" * 200 + "c"]
    texts = once + runs + within + mixed
    noise = "".join(map(chr, np.random.default_rng(4).integers(97, 123, suffix.CHUNK_BYTES + 1000).tolist()))
    at = suffix.CHUNK_BYTES - 250
    across = noise[:at] + "=-" * 300 + noise[at:]  # the run crosses the border of two parts
    tables = [docs_of(spark, t) for t in (texts, ["b" * 300], ["cd" * 150 + prose(3, 40)], [across, "-=" * 101])]
    for size in (rounds.BLOCK_BYTES, 700):
        monkeypatch.setattr(rounds, "BLOCK_BYTES", size)
        for df in tables[: 4 if size > 700 else 3]:
            assert Counter(tuple(r) for r in suffix.deduplicate(df).collect()) == _wanted_bytes(df)


def test_suffix_dedup_of_a_long_run(spark):
    """Eight million equal bytes have few representatives."""
    (row,) = suffix.deduplicate(docs_of(spark, ["a" * 8_000_000])).collect()
    assert (row.n_bytes, row.n_removed, row.n_spans) == (8_000_000, 8_000_000, 1)


def test_suffix_dedup_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert Counter(tuple(r) for r in suffix.deduplicate(df).collect()) == _wanted_bytes(df)


def test_words_of_equal_hashes_are_different_words(spark):
    x, y = _colliding()
    a, b = "a b c d e f", "g h i j k l m n o p"
    df = docs_of(spark, [f"{a} {x} {b}", f"{a} {y} {b}", f"{a} {x} {b}"])
    assert [(r.doc_id, r.n_removed) for r in recompress.deduplicate(df).orderBy("doc_id").collect()] == [(0, 0), (1, 0), (2, 17)]
    assert [(r.doc_id, r.component_id) for r in sketch.near_duplicates(df, 85).orderBy("doc_id").collect()] == [(0, 0), (1, 1), (2, 0)]
    assert [(r.doc_id, r.n_shingles) for r in sketch.near_duplicates(docs_of(spark, [f"{x} a b c d {y} a b c d"]), 85).collect()] == [(0, 6)]


def test_long_texts_are_read_in_parts(spark):
    """Several parts of one text: a passage across their borders and its copy elsewhere are found."""
    rng = np.random.default_rng(8)
    long = " ".join(map("{:x}".format, rng.integers(0, 1 << 40, 150_000)))  # 1.6 MB
    at = len(" ".join(long.split()[: (1 << 16) - 20]))
    df = docs_of(spark, [long, long[at : at + 600], long[(512 << 10) - 300 : (512 << 10) + 300]])
    got = {r.doc_id: r for r in suffix.deduplicate(df).collect()}
    assert (got[0].n_removed, got[0].n_spans, got[1].n_removed, got[2].n_removed) == (1200, 2, 600, 600)
    got = {r.doc_id: r for r in recompress.deduplicate(df).collect()}
    whole = set(long.split())
    for k in (1, 2):  # the ends of the copies may be parts of words
        assert got[k].n_removed >= got[k].n_words - 2 and got[k].n_words - got[k].n_removed == sum(w not in whole for w in df.filter(f"doc_id = {k}").first().text.split())
    assert got[0].n_removed == 0 and got[0].n_words == 150_000


def test_substring_dedup_against_brute_force(spark, odd, monkeypatch):
    texts = [(r.doc_id, (r.text or "").encode().split()) for r in odd.collect()]
    low = {}
    for doc, ws in texts:
        for i in range(len(ws) - 12):
            if doc is not None:
                low[tuple(ws[i : i + 13])] = min(doc, low.get(tuple(ws[i : i + 13]), doc))
    want = Counter()
    for doc, ws in texts:
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - 12):
            if doc is not None and low[tuple(ws[i : i + 13])] < doc:
                gone[i : i + 13] = True
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        want[(doc, len(ws), int(gone.sum()), hashlib.sha256(kept).hexdigest())] += 1
    monkeypatch.setattr(rounds, "BLOCK_BYTES", 8_000)
    assert Counter(tuple(r) for r in recompress.deduplicate(odd).collect()) == want


def shingles(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def test_near_dedup_against_brute_force(spark, odd):
    base = prose(7, 150).split()
    edits = []
    rng = np.random.default_rng(4)
    for k in range(60):  # a family around one text, from one edit to eight
        copy = list(base)
        for at in rng.integers(0, 150, 1 + k % 8):
            copy[at] = f"n{k}x{at}"
        edits.append(" ".join(copy))
    df = odd.unionByName(docs_of(spark, edits, 100))
    rows = [(r.doc_id, shingles(r.text)) for r in df.collect()]
    for percent in (85, 80):
        comp = {d: d for d, _ in rows if d is not None}
        sets = [(d, s) for d, s in rows if d is not None and s]
        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if 100 * len(x & y) >= percent * len(x | y):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {d: low if c == high else c for d, c in comp.items()}
        want = Counter((d, len(s), None if d is None else comp[d], d is not None and comp[d] == d) for d, s in rows)
        assert Counter(tuple(r) for r in sketch.near_duplicates(df, percent).collect()) == want


def test_embedding_dedup_cases_and_recall(spark, monkeypatch):
    rng = np.random.default_rng(0)
    vecs = [rng.standard_normal(16) for _ in range(300)]
    vecs += [v + 0.02 * rng.standard_normal(16) for v in vecs[:120]] + [vecs[0] + 0.01 * rng.standard_normal(16) for _ in range(80)]
    rows = [(k, [float(x) for x in v], k % 2 if k < 300 else (k - 300) % 2 if k < 420 else 0) for k, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [None] + [1.0] * 15, 0), (903, [float("nan")] * 16, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [], 0), (None, rows[0][1], 0), (908, rows[0][1], 0), (908, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    fit = [(i, np.array(v), g) for i, v, g in rows if i is not None and i not in (900, 901, 902, 903, 904, 907)]
    links, comp = defaultdict(int), {i: i for i, _, _ in rows if i is not None}
    for i, (a, x, g) in enumerate(fit):
        for b, y, h in fit[:i]:
            if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    links[908] //= 2  # two rows of one id, each linked as often
    for leaf, crowd in ((96, 2048), (24, 20)):
        monkeypatch.setattr(forest, "LEAF", leaf)
        monkeypatch.setattr(forest, "CROWDED", crowd)
        monkeypatch.setattr(forest, "BLOCK", 10)
        got = forest.near_duplicates(df).collect()
        assert len(got) == len(rows)
        found = sum(r.n_links for r in got if r.vec_id is not None)
        want = sum(links[i] for i, _, _ in rows if i is not None)
        assert 0.99 * want <= found <= want
        for r in got:
            if r.vec_id is not None:
                assert r.n_links <= links[r.vec_id] and r.component_id >= comp[r.vec_id] and r.kept == (r.component_id == r.vec_id)


def test_url_cases(spark):
    rows = [(1, "http://A.NET/x?y"), (2, "https://www.example.net/en/1#t"), (3, "http://example.com/de/2"), (4, "http://blog.org/fr/"), (5, None), (6, "no scheme"), (7, "://h"), (8, "http://a.net"), (None, "http://x.org/EN/1"), (1, "http://A.NET/x?y")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, 0, 1) for k in range(100, 120)] + [(None, 1, 1), (121, None, None)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(k, f"http://spam.com/win/{k}") for k in range(100, 120)] + [(200, "http://spam.com/win/77"), (201, "http://fine.com/win/7")], "page_id long, url string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judge(pages.unionByName(more), labels).collect()}
    assert got[(1, "a.net", "/x")] == ("net/", "block") and got[(2, "www.example.net", "/en/1")] == ("example.net/en/", "allow")
    assert got[(3, "example.com", "/de/2")] == ("example.com/de/", "block") and got[(4, "blog.org", "/fr/")] == ("org/fr/", "allow")
    assert got[(5, "", "")][0] is None and got[(6, "", "")][0] is None and (7, "h", "") in got and got[(8, "a.net", "")][0] is None
    assert got[(200, "spam.com", "/win/77")] == (None, "block")
    assert urls.judge(pages.limit(0), labels).count() == 0 and urls.judge(pages, labels.limit(0)).count() == len(rows)


def test_search_cases(spark):
    rows = [(0, [1.0, 0.5], 1), (50, [0.25, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 1.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("inf"), 1.0], 1), (None, [9.0, 9.0], 1), (6, [2.0], 1), (7, [], 1), (1, [1.0, 1.0], 1)]
    got = search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 50, 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id == 0) == [(0, 1, 6, 131072), (0, 2, 1, 98304), (0, 3, 1, 98304)]
    assert search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), 50).count() == 0
    assert [tuple(r) for r in search.top_k(spark.createDataFrame([(0, []), (1, []), (0, [])], "vec_id long, embedding array<double>"), 50).collect()] == [(0, 1, 1, 0)]


def test_search_scores_beyond_doubles(spark, monkeypatch):
    big, small = 2.0**20 / 256, 2.0**-8 / 256
    shape = "vec_id long, embedding array<double>, score string, rank int"  # names of the result's columns too
    make = lambda rows: spark.createDataFrame([(i, v, "x", -1) for i, v in rows], shape)
    rows = [(0, [2.0**20, 2.0**-8]), (5, [2.0**19, 0.0]), (7, [2.0**19, 2.0**-8])]
    assert [tuple(r) for r in search.top_k(make(rows), 50, 1).collect()] == [(0, 1, 7, (1 << 55) + 1)]
    twice = [(0, [2.0**20]), (3, [2.0**18]), (3, [2.0**19])]
    assert sorted(tuple(r) for r in search.top_k(make(twice), 50, 2).collect()) == [(0, 1, 3, 1 << 55), (0, 2, 3, 1 << 54)]
    huge = [(0, [1e300, big]), (1, [1e300, small]), (2, [-1e300, 1.0]), (3, [1e308, 1.0]), (4, [0.0, 1.0])]
    assert sorted(tuple(r) for r in search.top_k(make(huge), 50, 5).collect()) == [(0, 1, 1, search.MOST), (0, 2, 4, 1 << 28), (0, 3, 2, search.LEAST)]
    rng = np.random.default_rng(6)
    many = [(k, [float(x) for x in rng.standard_normal(8)]) for k in range(600)]
    one = sorted(tuple(r) for r in search.top_k(make(many), 10, 3).collect())
    monkeypatch.setattr(search, "GROUP_BYTES", 1000)
    assert sorted(tuple(r) for r in search.top_k(make(many), 10, 3).collect()) == one and len(one) == 180


def test_language_cases_and_held_out_accuracy(spark, sf, odd):
    got = queries.op4_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 250 and right / n > 0.95
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"), ~langid.held_out())
    out = {r.doc_id: r for r in langid.predict(odd, model).collect() if r.doc_id is not None}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[1].score == 0 and 0 <= out[0].score <= 1
    assert out[0].kept == "clash"
    none = langid.train(odd.filter("doc_id < 0"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_secret_query_cases(spark, odd):
    assert odd.count() == secrets.secret_spans(odd).count()
    row = secrets.secret_spans(docs_of(spark, ["é api-key api_key: abcdefgh"])).first()
    assert (row.n_assign, row.spans, row.base_sha256) == (1, "assign:10:27", hashlib.sha256(b"assign:10:27").hexdigest())
    assert secrets.secret_spans(docs_of(spark, [None])).first().base_sha256 == hashlib.sha256(b"").hexdigest()


def test_mixing_cases(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (8, None, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed(odd.select("doc_id", "text"), labels).collect()
    assert len(got) == odd.count() and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-6 for r in got)
    assert mixing.resampled(odd, labels.limit(0)).columns == odd.columns
    assert mixing.mixed(odd.limit(0), labels).count() == 0


def test_mixing_meets_targets(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixed(docs.select("doc_id", "text"), labels).toPandas()
    totals = sum((np.array(p) * n * r for p, n, r in zip(got["posterior"], got["n_tokens"], got["rate"], strict=True)), np.zeros(3))
    share = np.array([mixing.SHARES[d] for d in mixing.DOMAINS])
    assert np.abs(totals / totals.sum() / share - 1).max() < 0.011


def test_a_mix_that_misses_its_targets_says_so(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PATIENCE", 3)
    rows = spark.createDataFrame([(10, [0.5, 0.5, 0.0]), (20, [0.5, 0.5, 0.0])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="misses"):
        mixing.fit_rates(rows, mixing.DOMAINS, {"good": 0.9, "low": 0.1, "toxic": 0.0})


def test_packing_query_round_trip(spark, odd):
    got = packing.pack(odd, queries.tokenizer_path(), 64).toPandas()
    by_bin = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by_bin["length"].sum() <= 64).all()
    for _, part in by_bin:
        assert part["offset"].tolist() == (part["length"].cumsum() - part["length"]).tolist()
    enc = packing.encoder(queries.tokenizer_path())
    for r in odd.filter("doc_id IN (0, 1, 8)").collect():
        n = len(enc.slowly(r.text or "")) // 4 + 1
        mine = got[got["doc_id"] == r.doc_id].sort_values("piece")
        assert mine["length"].sum() == n and mine["start"].tolist() == (mine["length"].cumsum() - mine["length"]).tolist()
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def test_pieces_without_ids_spread_over_the_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 100)
    got = packing.pack(docs_of(spark, ["NOID"] * 1000), queries.tokenizer_path(), 64).toPandas()
    shard = (got["sequence_id"] // (1 << 32)).value_counts()
    assert len(got) == 1000 and len(shard) == 10 and shard.max() < 160


def test_dedup_tells_texts_of_one_id_apart(spark):
    near = prose(2, 120)
    texts = [(7, prose(20, 50)), (7, prose(21, 50)), (8, near), (3, near + " x"), (3, near + " x"), (9, ""), (9, ""), (None, near), (5, near + " y")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, t int").withColumn("cls", F.lit("clash"))
    got = sketch.deduplicated(docs, 80)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([*texts[:2], texts[3], *texts[5:8]])
    joined = {r.doc_id: r.component_id for r in sketch.near_duplicates(docs, 80).collect()}
    assert joined == {7: 7, 8: 3, 3: 3, 9: 9, None: None, 5: 3}


@pytest.mark.parametrize("block", [1 << 9, 1 << 22])
def test_clumps_are_compared_in_blocks_of_bounded_bytes(spark, monkeypatch, block):
    monkeypatch.setattr(sketch, "BLOCK_BYTES", block)
    monkeypatch.setattr(sketch, "TASK_BYTES", 4 * block)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(24):  # sets of 100 to 330 around one core
        core = [("s", j) for j in range(100)] + [("m", j) for j in range(int(rng.integers(0, 30)) * 8)]
        rows.append((k, np.sort(np.unique(np.array([hash_of(x) for x in core] + rng.integers(0, 1 << 62, 5).tolist(), np.uint64)))))
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in rows], "id long, shingles binary")
    clumps = spark.createDataFrame([(k, 0, len(s)) for k, s in rows], "id long, clump long, n long")
    linked = spark.createDataFrame([(0, 0), (1, 0)], "id long, component long")
    got = {(r.a, r.b) for r in sketch._across(sets, clumps, linked, 85).collect()}
    comp = {k: k for k, _ in rows} | {1: 0}
    alike = [(a, b) for a, x in rows for b, y in rows if a < b and sketch.alike(x, y, 85)]
    assert got <= {p for a, b in alike for p in ((a, b), (b, a))}

    def united(links):
        c = dict(comp)
        for a, b in links:
            c = {k: min(c[a], c[b]) if v in (c[a], c[b]) else v for k, v in c.items()}
        return c

    assert united(got) == united(alike) and len(set(united(got).values())) > 1


def hash_of(x):
    return int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") >> 2


@pytest.mark.parametrize("run", [lambda d: suffix.deduplicate(d), lambda d: recompress.deduplicate(d), lambda d: sketch.near_duplicates(d, 85), lambda d: secrets.secret_spans(d)])
def test_empty_tables(spark, odd, run):
    assert run(odd.limit(0)).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as pipeline
    from riskweave.llm.common import written

    sf = "/root/testdata/sf0.001"
    extra = docs_of(spark, ["password=abcdefgh12 in some text", "!!! 123"], 5000).select("doc_id", "text", "lang", "source", "n_chars")
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra)
    before = docs
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, before, sf))
        ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
        if name != "best_fit_packing":
            assert after.columns == docs.columns and ids(after) <= ids(before)
        if name == "language_id":
            assert ids(before) - ids(after) == {5001}
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, shingles(r.text)) for r in before.collect()]
            comp = {d: d for d, _ in rows}
            for i, (a, x) in enumerate(rows):
                for b, y in rows[:i]:
                    if x and y and 100 * len(x & y) >= 80 * len(x | y):
                        low, high = sorted((comp[a], comp[b]))
                        comp = {d: low if c == high else c for d, c in comp.items()}
            assert ids(after) == {d for d, c in comp.items() if d == c}
        if name == "secret_scan":
            assert ids(after) == ids(before)
            assert after.filter("doc_id = 5000").first().text == "[assign] in some text"
            assert all(r.text == secrets.masked(r.text) and r.n_chars == len(r.text) for r in after.collect())
        if name == "mixing":
            assert 0 < after.count() <= 1.5 * before.count()
        if name == "best_fit_packing":
            assert ids(after) == ids(before)
        before = after


def test_mixing_keeps_what_scarce_or_missing_domains_leave(spark):
    texts = [prose(k, 60) for k in range(196)] + [("vile%d " % (k % 3)) * 60 for k in range(4)]
    docs, none = docs_of(spark, texts), "doc_id long, quality int, toxic int"
    few = spark.createDataFrame([(k, 1, int(k >= 196)) for k in range(200)], none)
    got = {r.doc_id: r.rate for r in mixing.mixed(docs.select("doc_id", "text"), few).collect()}
    assert min(got[k] for k in range(196)) > 0.9 and min(got[k] for k in range(196, 200)) > 1.2
    gone = spark.createDataFrame([(k, 1, 0) for k in range(900, 950)], none)
    for labels in (few.limit(0), gone, few.filter("toxic = 0")):
        assert sorted(r.doc_id for r in mixing.resampled(docs, labels).select("doc_id").collect()) == list(range(200))


def test_mixing_learns_from_long_texts(spark):
    docs = docs_of(spark, [prose(k, 6000) for k in range(6)] + ["vile words " * 2500 for _ in range(3)])
    labels = spark.createDataFrame([(k, 1, int(k >= 6)) for k in range(9)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.posterior for r in mixing.mixed(docs.select("doc_id", "text"), labels).collect()}
    assert all(got[k][0] > 0.5 for k in range(6)) and all(got[k][2] > 0.5 for k in range(6, 9))


def test_language_of_long_texts_and_null_ids(spark):
    long = {"en": "the cat and the house with which they were ", "de": "der Hund und das Haus mit dem sie waren "}
    rows = [(k, long[g] * 300, g) for k, g in enumerate(["en", "de"] * 4)] + [(None, long["en"], "en"), (None, "x y z", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.langs == ["de", "en"]
    assert all(r.lang == r.lang_pred for r in langid.predict(docs.filter("doc_id IS NOT NULL"), model).collect())


def test_urls_differ_below_the_first_levels(spark):
    urls_of = {0: "/a/b/c/d/news/{}", 1: "/a/b/c/d/spam/{}", 2: "/a/b/c/d/e/f/g/h/news/{}", 3: "/a/b/c/d/e/f/g/h/spam/{}"}
    rows = [(100 * g + k, "http://host.info" + path.format(k)) for g, path in urls_of.items() for k in range(20)]
    rows += [(999, "http://host.info/a/b/c/d/spam/77"), (998, "http://host.info/a/b/c/d/news/77"), (997, "http://host.info/a/b/c/d"), (996, "http://short.info/a")]
    labels = spark.createDataFrame([(p, 1, p // 100 % 2) for p, _ in rows if p < 900], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert len(got) == len(rows) and all(got[p] == ("block" if p // 100 % 2 else "allow") for p in got if p < 900)
    assert got[999] == "block" and got[998] == "allow"


def test_url_templates_are_a_tree(spark):
    """Variable segments become wildcards, alike branches merge, unlike ones and other depths don't."""
    words = "ant bee cat dog elk fox gnu hen ibis jay kite lynx".split()
    rows = [f"/item/{w}/x" for w in words] + ["/en/1", "/en/2", "/a/b/c/d/e"] + [f"/win/{k}" for k in range(8)] + ["/"]
    rows += [f"/news/{k}" for k in range(8)] + [f"/blog/{k}" for k in range(8)]
    pages = spark.createDataFrame([(k, "http://h.info" + p, "x") for k, p in enumerate(rows)], "page_id long, url string, template string")
    labels = spark.createDataFrame([(k, 1, int(p.startswith("/win"))) for k, p in enumerate(rows) if p[:5] in ("/win/", "/news", "/blog")], "doc_id long, quality int, toxic int")
    got = {rows[r.page_id]: (r.template, r.verdict) for r in urls.judge(pages, labels).collect()}
    assert {got[f"/item/{w}/x"][0] for w in words} == {"/item/*/x"} and got["/en/1"][0] == got["/en/2"][0] == "/en/{n}"
    assert got["/a/b/c/d/e"][0] == "/a/b/c/d/e" and got["/"][0] == "/"
    assert got["/win/3"] == ("/win/{n}", "block") and got["/news/3"][1] == got["/blog/3"][1] == "allow"
    few = urls.judge(pages, labels.filter("toxic = 1").limit(2))
    assert {r.verdict for r in few.collect()} == {"allow"}  # two labelled pages are not evidence enough


def test_url_tree_has_as_many_rounds_as_branchings(spark):
    deep = "/".join(["a"] * 300)
    pages = spark.createDataFrame([(k, f"http://h.info/{deep}/{w}") for k, w in enumerate(["x", "y", "x/z"])], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(r.template for r in urls.judge(pages, none).collect()) == [f"/{deep}/{w}" for w in ("x", "x/z", "y")]


def _base_spans(text):
    """The contract's base spans without regular expressions, by a scan from each place."""
    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    letters, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = set(letters + letters.lower() + digits + "+/_.=-")
    out, at = [], 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
            if text[at : at + len(word)].isascii() and text[at : at + len(word)].lower() == word:
                p = at + len(word)
                p = p + 1 if text[p : p + 1] in ('"', "'") else p
                p = run(p, " ")
                if text[p : p + 1] in (":", "="):
                    p = run(p + 1, " ")
                    p = p + 1 if text[p : p + 1] in ('"', "'") else p
                    if run(p, value) > p:
                        end = run(p, value)
                        if end - p >= 8:
                            out.append((at, 0, end))
                break
        at = end or at + 1
    for kind, least, first, allowed in ((1, 16, "AKIA", letters + digits), (2, 32, "", digits + "abcdef")):
        at = 0
        while at < len(text):
            end = run(at + len(first), allowed) if text.startswith(first, at) else at
            if end > at + len(first):
                if end - at >= least:
                    out.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(out)


def test_base_secrets_against_another_scanner(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    key = "AKIA" + "QWERTYUIOPAS1234"
    extra = docs_of(spark, [f"token=token=abcdefgh {key}{key}", "secret: 'secret: \"abcdefghij", "password  password=12345678 api_key':=abcdefgh", "apikey=" + "0123456789abcdef" * 3, "ſecret=abcdefgh TOKEN:ABCDEFGH"], 10**6)
    want = {}
    for r in docs.unionByName(extra.select("doc_id", "text")).collect():
        spans = _base_spans(r.text or "")
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[r.doc_id] = (*(sum(s[1] == k for s in spans) for k in range(3)), hashlib.sha256(told.encode()).hexdigest())
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.secret_spans(docs.unionByName(extra.select("doc_id", "text"))).collect()}
    assert got == want and sum(sum(w[:3]) for w in want.values()) > 10


def test_entropy_finds_planted_secrets_and_leaves_ordinary_runs(spark):
    """Precision and recall of the entropy rule, on secrets of each class and runs that look like them."""
    rng = np.random.default_rng(12)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    planted = {"hex": [pick(dig + "ABCDEF", int(rng.integers(24, 65))) for _ in range(200)], "alnum": [pick(low + up + dig, int(rng.integers(24, 65))) for _ in range(200)], "base64": [pick(low + up + dig + "+/_-", int(rng.integers(24, 65))) for _ in range(200)]}
    word = lambda: pick(low, int(rng.integers(3, 9)))
    title = lambda: word().title()
    ordinary = [f"{pick(dig + 'abcdef', 8)}-{pick(dig + 'abcdef', 4)}-{pick(dig + 'abcdef', 4)}-{pick(dig + 'abcdef', 4)}-{pick(dig + 'abcdef', 12)}" for _ in range(100)]
    ordinary += ["/" + "/".join(word() for _ in range(6)) for _ in range(100)] + ["_".join(word() for _ in range(5)) + "_2024" for _ in range(100)]
    ordinary += ["".join(title() for _ in range(6)) for _ in range(100)] + ["-".join([word(), word(), word(), pick(dig, 6)]) for _ in range(100)] + ["=" * 30, "-" * 40, pick(dig, 30), "2024-01-01-2024-12-31"]
    rows = [s for kind in planted.values() for s in kind] + ordinary
    docs = docs_of(spark, [f"{prose(k, 8)} {s} {prose(k + 1, 8)}" for k, s in enumerate(rows)])
    got = {r.doc_id: r.spans for r in secrets.secret_spans(docs).collect()}
    found = {kind: np.mean(["entropy" in got[n * 200 + k] for k in range(200)]) for n, kind in enumerate(planted)}
    wrong = [rows[k] for k in range(600, len(rows)) if got[k]]
    print(found, len(wrong), wrong[:5])
    assert min(found.values()) >= 0.95 and len(wrong) <= 0.02 * len(ordinary)
    whole = [k for k in range(600) if (s := sorted(tuple(map(int, p.split(":")[1:])) for p in got[k].split(",") if p)) and sum(b - a for a, b in s) >= 0.9 * len(rows[k])]
    assert len(whole) >= 0.9 * 600


def test_empty_tables_and_clashing_columns(spark):
    import corpus_pipeline as pipeline

    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0, "x", "y"), (2, [1.0, 0.01], 0, "x", "y")], "vec_id long, embedding array<double>, label int, n_links string, component_id string")
    assert {(r.vec_id, r.n_links, r.component_id) for r in forest.near_duplicates(vectors).collect()} == {(1, 1, 1), (2, 1, 1)}
    assert forest.near_duplicates(vectors.limit(0)).count() == 0
    named = docs_of(spark, ["the cat and the house"] * 3).drop("component_id", "kept").withColumns({c: F.lit("x") for c in ("lang_pred", "score", "rate", "posterior", "n_tokens", "spans", "piece", "length", "shard", "__predicted")})
    model = langid.train(spark.createDataFrame([(1, "the cat", "en"), (2, "der Hund", "de")], "doc_id long, text string, lang string"), F.lit(True))
    assert langid.predict(named.limit(0), model).count() == 0 and {r.lang_pred for r in langid.predict(named, model).collect()} == {"en"}
    assert secrets.secret_spans(named).count() == packing.pack(named, queries.tokenizer_path()).count() == 3
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0
