import numpy as np

from tasteframe.llm import ann


def brute(ids, x, k=20):
    out = {}
    for i in np.nonzero(ids % 20 == 0)[0]:
        s = np.einsum("ij,j->i", x, x[i])
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(np.float64)
    want = brute(ids, x)
    got = {}
    for r in ann.op7_one_bit_codes(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.99 * sum(map(len, want.values()))
    for q in want:
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        scores = dict(zip(ids.tolist(), x @ x[np.nonzero(ids == q)[0][0]], strict=True))
        assert all(abs(s - scores[v]) < 1e-12 for v, s in got[q])


def test_odd_vectors_ties_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"), (6, [1.0, None], "a"),
            (20, [1.0, 0.0], "a"), (20, [1.0, 0.0], "a"), (7, [2.0, -1.0], "a"), (None, [1.0, 1.0], "a"), (8, [1.0, 2.0, 3.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert ann.search(df.limit(0), "vec_id % 20 = 0").count() == 0


def test_copies_keep_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "vec_id long, embedding array<float>")
    got = ann.search(df, "vec_id = 60 or vec_id = 0", k=20, candidate_block=16, query_block=1).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [*range(1, 21), *range(20)]


def test_no_neighbour_is_lost(spark):
    """One dimension, huge finite components, and vectors that differ by little."""
    rng = np.random.default_rng(6)
    line = [[float(v)] for v in rng.standard_normal(400)]
    near = [[1.0 + float(v) * 1e-7, 1.0] for v in rng.standard_normal(400)]
    huge = [[1e30, 2e30], [-1e30, 1e30], [3e30, 1.0]]
    for rows in (line, near, huge):
        df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
        x = np.array(rows)
        got = {}
        for r in ann.search(df, "vec_id % 20 = 0").collect():
            got.setdefault(r.query_id, []).append(r.score)
        for q in range(0, len(rows), 20):
            want = np.sort(np.delete(np.einsum("ij,j->i", x, x[q]), q))[::-1][:20]
            assert len(got[q]) == len(want) and np.allclose(sorted(got[q], reverse=True), want, rtol=1e-12)
