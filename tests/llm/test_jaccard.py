import random
import re

import numpy as np
from pyspark.sql import functions as F

from tasteframe.llm import jaccard
from tasteframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    sets = {}
    for k, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    shared = {}
    for own in by_shingle.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute({r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op5_jaccard_join(spark, sf).collect()}
    assert got == want


def test_chains_of_edits_and_odd_rows(spark):
    random.seed(2)
    words = [f"w{i}" for i in range(300)]
    texts, k = {}, 0
    for _ in range(6):
        t = [random.choice(words) for _ in range(120)]
        for _ in range(15):
            t = list(t)
            t[random.randrange(len(t))] = random.choice(words)
            if random.random() < 0.2:
                del t[random.randrange(len(t))]
            texts[k], k = " ".join(t), k + 1
    passage = " ".join(random.choice(words) for _ in range(60))
    for _ in range(20):
        texts[k], k = passage + " " + " ".join(random.choice(words) for _ in range(random.randint(0, 20))), k + 1
    texts |= {500: "", 501: None, 502: "Two words", 503: "two WORDS", 504: "a b c d", 505: " \n", 506: "two"}
    rows = [(a, t, "x", 1) for a, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute(texts)
    more = df.where("doc_id in (502, 500)").union(df.where("doc_id in (500, 502)")).union(df.where("doc_id = 503").selectExpr("cast(null as long)", "text", "id", "n"))
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard.near_duplicates(more).collect()) == [(0, 502), (500, 500), (500, 500), (502, 502), (502, 502)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (300, 7)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 300: 0}


def test_signatures_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n, m in ((1, 1), (400, 500), (500, 520), (1000, 1100), (3000, 4000), (5000, 6000)):
        whole = rng.integers(0, 2**63, 2 * m).astype(np.uint64)
        for apart in (0, n // 10, n // 2):
            a, b = np.unique(whole[:n]), np.unique(whole[apart : apart + m])
            rows.append((len(rows), jaccard.signature(a).tolist(), jaccard.signature(b).tolist()))
            want.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame(rows, "i int, x array<long>, y array<long>")
    got = [r.d for r in df.select("i", jaccard.differing_bits(F.col("x"), F.col("y")).alias("d")).orderBy("i").collect()]
    assert all(g <= w and (g > 0.25 * w or w < 9) for g, w in zip(got, want, strict=True))


def test_no_query_of_the_join_is_large(spark, monkeypatch):
    # a query of many joins fills the driver's memory: it is planned and described anew at each of its stages
    joins, write = {}, jaccard.written

    def counted(df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        joins[name] = max(joins.get(name, 0), len(re.findall(r"\bJoin ", plan)))
        return write(df, name)

    monkeypatch.setattr(jaccard, "written", counted)
    texts = [(i, f"{'same words in every text ' * 3}{' '.join(f'w{i // 3 * 50 + j}' for j in range(30 + i % 3))}") for i in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute(dict(texts))
    assert joins["pairs"] > 1 and max(joins.values()) <= 8, joins
