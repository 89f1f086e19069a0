import random
import time
import zlib
from collections import Counter

import numpy as np

from tasteframe.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op6_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    got = [(labels[r.doc_id], r.predicted) for r in held if r.doc_id in labels]
    hit = sum(y and p for y, p in got)
    print(len(got), hit, sum(y for y, _ in got), sum(p for _, p in got))
    assert hit >= 0.9 * sum(y for y, _ in got) and hit >= 0.8 * sum(p for _, p in got)


def test_label_model_finds_accuracies_and_groups():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.15
    fire = lambda a, b: np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b)
    v = np.stack([fire(0.6, 0.01), fire(0.5, 0.02), fire(0.4, 0.01), fire(0.5, 0.01)], axis=1).astype(float)
    v = np.concatenate([v, v[:, :1]], axis=1)  # a voter twice
    model = toxicity.fit_label_model(v)
    assert model.groups[4] == model.groups[0] and len(set(model.groups[:4])) == 4
    assert (model.votes > 0).all()
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(["bad moron", "fine day", None, "", "a m0ron", "x" * 50000] * 12)], "doc_id long, text string, mark_ int")
    labels = spark.createDataFrame([(i, int(i % 6 in (0, 4))) for i in range(72)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels, "doc_id % 3 = 2").collect()
    assert len(rows) == 72 and all((r.score >= 0.3) == (r.doc_id % 6 in (0, 4)) for r in rows)
    assert toxicity.score(docs, labels.limit(0), "false").count() == 72
    assert toxicity.score(docs.limit(0), labels, "false").count() == 0


def test_learns_from_all_training_rows(spark):
    # far more labelled rows than the linear fit takes; a rare word, and votes on rows without a label
    texts = ["bad moron", "fine day", "good sun", "nice tree"] * 150 + ["vile zork"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, "vile zork") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("moron" in t or "zork" in t)) for i, t in enumerate(texts)], "doc_id long, toxic int")
    rows = {r.doc_id: r.score for r in toxicity.score(docs, labels, "doc_id >= 1030", most_rows=40).collect()}
    assert all((rows[i] >= 0.3) == ("moron" in t or "zork" in t) for i, t in enumerate(texts))
    assert all(rows[1000 + i] >= 0.3 for i in range(40))


def test_rounds_in_spark_equal_those_in_memory(spark):
    rng = np.random.default_rng(5)
    toxic = rng.random(3000) < 0.2
    fired = (rng.random((3000, 6)) < np.where(toxic[:, None], 0.6, 0.03)).astype(float)
    fired[:, 5] = fired[:, 4]  # a copy shares its vote
    rows = Counter(tuple(int(i) for i in np.nonzero(r)[0]) for r in fired)
    patterns = spark.createDataFrame([(list(v), n) for v, n in rows.items()], "votes array<int>, n long").repartition(3)
    for got, silence in zip(toxicity.fit_patterns(patterns, 6, (1.0, 0.25)), (1.0, 0.25), strict=True):
        want = toxicity.fit_label_model(fired, silence=silence)
        assert got.groups.tolist() == want.groups.tolist() == [0, 1, 2, 3, 4, 4]
        assert abs(got.prior - want.prior) < 1e-4 and np.allclose(got.votes, want.votes, atol=1e-3) and np.allclose(got.silence, want.silence, atol=1e-3)
        assert np.allclose(got.posterior(fired), want.posterior(fired), atol=1e-3)
    # no voters, and no texts
    assert len(toxicity.fit_patterns(patterns.where("size(votes) = 0"), 0)[0].votes) == 0
    assert np.all(toxicity.fit_patterns(patterns.limit(0), 2)[0].votes == 0)


def test_finder_finds_what_features_say():
    # known words are skipped, kept or spelled anew as the cache fills: what is found stays the same, and cheap
    rng = random.Random(7)
    words = ["".join(rng.choice("abM0rn!@ é") for _ in range(rng.randrange(1, 16))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 60))).encode() for _ in range(200)] + [b"", b"A!!", b"ABc ***", b"\xff\xfe bad"]
    every = sorted({f for t in texts for w in t.lower().split() for f in toxicity.word_features(w)})
    number = {f: i for i, f in enumerate([*rng.sample(every, 150), "x:capitals", "x:bangs", "x:signs"])}
    finder = toxicity.Finder(number)
    for t in texts * 2:
        letters = [c for c in t.decode("latin-1") if c.isascii() and c.isalpha()]
        assert ("x:capitals" in toxicity.text_features(t)) == (2 * sum(c.isupper() for c in letters) > len(letters))
        own = {*toxicity.text_features(t), *(f for w in t.lower().split() for f in toxicity.word_features(w))}
        assert finder.find(t) == {number[f] for f in own if f in number}
    long = b"plain words of one text " * 200_000
    began = time.process_time()
    toxicity.text_features(long)
    one = time.process_time() - began
    began = time.process_time()
    long.lower().split()
    assert one < 2 * (time.process_time() - began)
