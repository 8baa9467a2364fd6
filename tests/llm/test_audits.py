"""Filter audit, source divergence and nearest neighbours against their definitions."""

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rugosa.llm import divergence, filter_audit, neighbours

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def texts(seed=0, n=40):
    rng = random.Random(seed)
    vocabulary = ["wort", "Straße", "été", "Zebra", "über", "THE", "and", "rare", "naïve", "x1y"]
    out = [" ".join(rng.choices(vocabulary[: rng.randint(1, 10)], k=rng.choice([1, 30, 250, 400]))) for _ in range(n)]
    return out + [None, "", " \n\t ", "50% off & more", "UPPER CASE ONLY", "é", out[0], out[0], None, "word " * 30_000, "a😀b 日本語"]


def table(spark, rows):
    """doc_id, text, lang, source, and columns whose names the operators use themselves."""
    kind = "doc_id long, text string, lang string, source string, n long, part string, term string, mask int, least long"
    return spark.createDataFrame([(*r, 9, "p", "t", 3, 1) for r in rows], kind)


def corpus(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i * 3 % 61, t, rng.choice(["de", "en", "", None]), rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts(seed))]
    return [*rows, rows[3], rows[3], (None, rows[0][1], "de", "a"), (None, None, None, None)]


def failures(text, words=200):
    text = text or ""
    w = WORD.findall(text)
    out = "A" if len(w) < words else ""
    out += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search("[#$%&*|]", text) else "")


def audited(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, lang, _ in rows:
        marks = [(q, x) for d, q, x in labels if d is not None and d == i]
        failed = failures(t) + ("E" if i is not None and i > least[t or ""] else "")
        docs.append((lang or "", failed, any(q == 1 for q, _ in marks), any(x == 1 for _, x in marks)))
    out, removed = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in map("".join, permutations("ABCDE")):
            alive = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in alive if f in d[1]]
                every = [d for d in docs if d[0] == part and f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                removed[part, f] += len(gone)
                figures = (len(alive), len(gone), len(every) - len(gone), sum(d[1] == f for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone))
                out[part, order, step] = figures
    return {k: (*v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_filter_audit(spark, seed):
    rows = corpus(spark, seed)
    rng = random.Random(seed)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 61, 2)] + [(0, 1, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    got = filter_audit.audit(filter_audit.document_cells(table(spark, rows), marks)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in got} == audited(rows, labels)
    assert len(got) == 600 * len({r[2] or "" for r in rows})


def test_filter_audit_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.document_cells(table(spark, []), marks)).count() == 0
    clean = [(1, " ".join(f"wort{i}" for i in range(300)), "de", "a")]
    got = filter_audit.audit(filter_audit.document_cells(table(spark, clean), marks)).collect()
    assert len(got) == 600 and {(r.kept, r.removed, r.shapley) for r in got} == {(1, 0, 0)}


def test_copies_are_counted_before_they_meet(spark):
    """One text in most rows: what reaches the place of its least id is a row a part and label, not a row a copy."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    docs = rows.select(F.col("id").alias("doc_id"), "text", F.lit("en").alias("lang"))
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r.mask: r.n for r in filter_audit.document_cells(docs, marks).collect()}
    assert cells == {1: 2001, 17: 17_999}


def diverging(rows):
    groups = {(r[2] or "", r[3] or "") for r in rows}
    counts, docs = {g: Counter() for g in groups}, Counter()
    for _, t, lang, source in rows:
        found = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        counts[lang or "", source or ""].update(found)
        docs.update({(lang or "", w) for w in found})
    out = {}
    for lang, source in groups:
        kept = [w for (g, w), n in docs.items() if g == lang and n >= 3]
        p = {}
        for who in [source, *{s for g, s in groups if g == lang and s != source}]:
            n = sum(counts[lang, who][w] for w in kept)
            p[who] = {w: 1 + 10**9 * (counts[lang, who][w] + 1) // (n + len(kept)) for w in kept}
        every = sum((counts[g] for g in groups if g[0] == lang), Counter())
        n = sum(every[w] for w in kept)
        q = {w: 1 + 10**9 * (every[w] + 1) // (n + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        pairs = [(sum(f(p[source][w], p[o][w]) for w in kept), o) for o in p if o != source]
        terms = [(f(p[source][w], q[w]), w) for w in kept if counts[lang, source][w] and p[source][w] > q[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                if part == "pair" or rank <= 200:
                    out[lang, source, part, rank] = (item, v)
    return out


@pytest.mark.parametrize("shard_bytes", [4_000_000, 20_000])
def test_source_divergence(spark, shard_bytes):
    rows = corpus(spark) + [(900 + i, f"Wort{'abcdefgh'[i % 8] * (i // 8 + 1)} und", "de", "ab"[i % 2]) for i in range(64)] + [(999, "...", "xx", "s"), (998, None, "xx", "t")]
    got = divergence.source_divergence(table(spark, rows), shard_bytes=shard_bytes).collect()
    assert {(r.lang, r.source, r.part, r.rank): (r.item, r.value) for r in got} == diverging(rows)
    assert len(got) == len(diverging(rows))


def test_source_divergence_of_nothing(spark):
    assert divergence.source_divergence(table(spark, [])).count() == 0
    one = [(r.lang, r.source) for r in divergence.source_divergence(table(spark, [(1, None, "de", None)])).collect()]
    assert one == []


def test_shards_add_up_rows_alike(spark, monkeypatch):
    """More rows of one term than a shard holds at once, and tasks that hand on what they hold."""
    monkeypatch.setattr(divergence, "HELD_ROWS", 3)
    rows = [(i, "eins zwei drei eins", "de", "ab"[i % 2]) for i in range(40)]
    got = divergence.counted(table(spark, rows).repartition(20), 2, 3).collect()
    assert {(r.source, r.term): r.n for r in got} == {(s, w): n * 20 for s in "ab" for w, n in (("eins", 2), ("zwei", 1), ("drei", 1))}
    assert {r.lang_n for r in got} == {80, 40} and sum(r["first"] for r in got) == 3


def vectors(spark, found, more=()):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.5, 7) for i, v in [*enumerate(found), *more]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


def brute(found, ids, queries, k):
    out = {}
    for q in queries:
        of = [(-float(np.float64(found[q]) @ np.float64(v)), i) for i, v in zip(ids, found) if i != q and len(v) == len(found[q])]
        out[q] = [(i, -s) for s, i in sorted(of)[:k]]
    return out


def searched(df, **options):
    out = {}
    for r in sorted(neighbours.nearest(df, F.col("vec_id") % 20 == 0, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbours_recall(spark, scaled):
    """Against brute force, unit vectors and such of very different lengths, in leaves and blocks of few rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) @ np.diag(np.linspace(1, 0.2, 24))
    x = x if scaled else x / np.linalg.norm(x, axis=1, keepdims=True)
    x = x.astype(np.float32)
    got = searched(vectors(spark, x), leaf_rows=200, block_rows=90)
    want = brute(x, range(len(x)), range(0, 3000, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20 and q not in {v for _, v, _ in found}
        assert all(abs(s - float(np.float64(x[q]) @ np.float64(x[v]))) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[q]})
    assert hits >= 0.93 * 20 * len(want)


def test_neighbours_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    x = [list(v) for v in rng.integers(-2, 3, (120, 3)).astype(float)]  # many equal vectors and ties
    x = [v if any(v) else [1.0, 0.0, 0.0] for v in x]
    x[40] = x[20] = x[0] = x[41]
    odd = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [1.0, float("nan"), 2.0]), (280, [float("inf"), 1.0, 0.0]), (300, []), (320, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])]
    got = searched(vectors(spark, x, odd), leaf_rows=16, block_rows=8, confidence=1 - 1e-9)
    want = brute(x, range(120), range(0, 120, 20), 20)
    assert {q: [(v, s) for _, v, s in f] for q, f in got.items()} == want  # 320 has no other of its length
    few = searched(vectors(spark, x[:7]))
    assert {q: [(v, s) for _, v, s in f] for q, f in few.items()} == brute(x[:7], range(7), [0], 20)
    assert searched(vectors(spark, [])) == {} and searched(vectors(spark, [[1.0, 2.0]])) == {}


def test_neighbours_of_a_hot_vector_and_of_repeated_ids(spark):
    """A third of the rows are one vector; ids that repeat are rows of their own."""
    x = np.random.default_rng(5).normal(size=(600, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[::3] = x[0]
    got = searched(vectors(spark, x), leaf_rows=64, block_rows=50)
    best = [i for i in range(3, 600, 3)]
    assert [v for _, v, _ in got[0]][:20] == best[:20] and [v for _, v, _ in got[60]] == [0, *[i for i in best if i != 60][:19]]
    twice = searched(vectors(spark, [[1.0, 0.0], [2.0, 0.0]], [(0, [1.0, 0.0]), (1, [2.0, 0.0])]))
    assert twice == {0: [(1, 1, 2.0), (1, 1, 2.0), (2, 1, 2.0), (2, 1, 2.0), (3, 0, 1.0), (3, 0, 1.0)]}


def test_chi_square_quantile():
    for m in (2, 8, 20):
        x = np.random.default_rng(m).chisquare(m, 400_000)
        assert abs((x < neighbours.chi_square_quantile(0.95, m)).mean() - 0.95) < 0.003


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_source_divergence"])
def test_query_matches_sql(spark, name):
    from rugosa.llm.queries import ORACLE_SQL, QUERIES

    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert list(got.columns) == list(want.columns)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
