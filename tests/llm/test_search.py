import math
import random
import re
from collections import Counter

from tasteframe.llm import search

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 100 - 75 + (75 * c.total() * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, n, doc, -score) for n, (score, _, _, doc) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df):
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_ranking_equals_brute_force(spark):
    rng = random.Random(5)
    common, rare = ["the", "of", "Ünd", "x9"], [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.6 else rng.choice(rare) for _ in range(rng.randint(0, 80)))
    docs = [(i, text()) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)] + [(900, "w1 W1-w1.w1"), (901, None), (902, ""), (None, docs[3][1]), (903, " ., \x00")]
    docs += [(904, "w7 of " * 60000)] + [(905, docs[8][1])] * 2
    items = [(i, text()) for i in range(30)] + [(90, docs[3][1]), (91, None), (92, "unheard"), (93, "w7 w7 W7"), (94, docs[3][1])]
    t = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item int").repartition(3)
    q = spark.createDataFrame([(*i, "") for i in items], "item_id long, text string, score string")
    want = sorted(brute(docs, items))
    assert rows(search.rank_documents(t, q)) == want
    assert rows(search.rank_documents(t, q, block=8)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # many shards
    try:
        assert rows(search.rank_documents(t, q, rounds=2)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{k} long, text string") for k in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert rows(search.rank_documents(docs, some)) == rows(search.rank_documents(docs, items)) == []
    assert rows(search.rank_documents(some.withColumnRenamed("item_id", "doc_id"), items)) == []


def test_stops_before_the_end():
    """With one rare and one frequent term, the best positions end the search long before the frequent list does."""
    import numpy as np

    n = 5000
    held = np.ones(n, dtype=np.int64)
    held[7] = 2
    term = np.concatenate([np.array([0, 1]) if i == 7 else np.array([1]) for i in range(n)])
    asked = search.Asked([(np.array([0, 1]), np.array([1, 1]))], np.array([8000, 10]), n, int(held.sum()))
    shard = search.Shard(held, np.concatenate(([0], np.cumsum(held))), term, np.ones(n + 1, dtype=np.int64), asked)
    looked = []
    look_up = shard.look_up
    shard.look_up = lambda docs, lists: looked.append(len(docs)) or look_up(docs, lists)
    docs, _ = shard.best(*asked.items[0], 1, 0)
    assert docs.tolist() == [7] and sum(looked) < 10
