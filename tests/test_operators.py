"""Operators on small literal inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasteframe.functions import scalars as S
from tasteframe.operators import blend, engagement, evaluate, itemitem, pagerank, serve
from tasteframe.plans.tables import Tables


@pytest.mark.parametrize("titles,kids,label", [(5, 5, "adult"), (10, 9, "kids"), (187, 66, "family"), (65, 32, "family"), (26, 4, "family"), (27, 4, "adult"), (305, 23, "adult"), (20, 3, "adult")])
def test_household_label(spark, titles, kids, label):
    assert spark.range(1).select(S.household_label(F.lit(titles), F.lit(kids))).first()[0] == label


def test_pooling_and_distinct_episodes(spark):
    plays = spark.createDataFrame(
        [(1, 10, 500, 1), (2, 11, 500, 2), (3, 12, 500, 3), (3, 12, 500, 3), (9, 10, 500, 4)], "user_id long, rating_key long, grandparent_rating_key long, date long"
    ).withColumns({"watched_status": F.lit(1.0), "percent_complete": F.lit(90), "product": F.lit("Web"), "player": F.lit(None).cast("string"), "platform": F.lit("roku")})
    titles = spark.createDataFrame([(500, "show", 5000)], "rating_key long, media_type string, tmdb_id long")
    alias = spark.createDataFrame([(2, 1), (3, 1)], "member long, canonical long")
    rows = {r.user_id: r for r in engagement.engagements(plays, titles, alias, 100).collect()}
    assert (rows[1].distinct_episodes, rows[1].completed_plays, rows[1].label) == (3, 4, "positive") and rows[9].label == "neutral"
    assert len(engagement.engagements(plays, titles, alias.limit(0), 100).collect()) == 4


def test_pagerank_equals_power_iteration(spark):
    rows = [(0, [1, 2, 9], [1]), (1, [2], []), (2, [0, 3], [0]), (3, [], [])]
    items = spark.createDataFrame([(k, "movie", [1], r, s) for k, r, s in rows], "tmdb_id long, media_type string, genres array<int>, recommendations array<long>, similar array<long>")
    a = np.zeros((4, 4))
    for k, rec, sim in rows:
        for w, ids in ((1.0, rec), (0.4, sim)):
            for i, j in enumerate(ids):
                if j < 4:
                    a[k, j] += w * (1 - 0.5 * i / max(1, len(ids) - 1))
    out = a.sum(1)
    t = (a / np.where(out > 0, out, 1)[:, None]).T
    restart = np.array([0.7, 0.3, 0, 0])
    p = restart.copy()
    for _ in range(8):
        p = 0.3 * restart + 0.7 * (t @ p + p[out == 0].sum() * restart)
    start = spark.createDataFrame([(1, "movie", k, float(v)) for k, v in enumerate(restart) if v], "walker long, media_type string, node long, p double")
    graph, nodes = pagerank.edges(items), items.select("media_type", F.col("tmdb_id").alias("node"))
    stays = pagerank.staying(graph, nodes, 8, Tables.cut)
    got = {r.node: r.p for r in pagerank.walk(graph, start, stays, 0.3, 8, Tables.cut).collect()}
    assert all(math.isclose(got.get(k, 0.0), p[k], abs_tol=1e-9) for k in range(4))


def test_item_item_closed_form(spark):
    x = np.array([[1, 1, 0, 0, 1], [1, 0, 1, 0, 0], [0, 1, 1, 0, 1], [1, 1, 1, 0, 0], [0, 0, 1, 1, 0], [1, 0, 0, 1, 1]], dtype=float)
    pairs = spark.createDataFrame([(int(u), int(i)) for u, i in zip(*np.nonzero(x), strict=True)], "user_id long, tmdb_id long")
    inverse = np.linalg.inv(x.T @ x + 5 * np.eye(5))
    b = -inverse / np.diag(inverse)[None, :]
    np.fill_diagonal(b, 0)
    got = {(r.src, r.dst): r.b for r in itemitem.weights(itemitem.gram(pairs), Tables.cut, 5.0).collect()}
    assert all(math.isclose(got.get((i, j), 0.0), b[i, j], abs_tol=1e-6) for i in range(5) for j in range(5))


def test_rerank_equals_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(1, k, "movie" if rng.random() < 0.4 else "show", float(1 - k / 40), k in (3, 5)) for k in range(25)]
    df = spark.createDataFrame(rows, "user_id long, tmdb_id long, media_type string, score double, continuation boolean")
    pool, out, movies, conts = list(rows), [], 0, 0
    while pool:
        n = len(out) % 10
        want = movies / n < 0.6 if n else True
        best = max(pool[:60], key=lambda r: (r[3] - 0.15 * ((r[2] == "movie") != want) - 0.15 * (conts >= 1 and r[4]), -pool.index(r)))
        pool.remove(best)
        out.append(best[1])
        movies, conts = (movies + (best[2] == "movie"), conts + best[4]) if len(out) % 10 else (0, 0)
    got = [r.tmdb_id for r in blend.rerank(df, spark.createDataFrame([(1, 0.6)], "user_id long, target double")).orderBy("place").collect()]
    assert got == out


def test_outside_order(spark):
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 9)], "user_id long, tmdb_id long, place int")
    given = spark.createDataFrame([(1, s, n) for s, n in enumerate([4, 2, 99, 4, 8, 1, 3])], "user_id long, seq int, number int")
    order = lambda df: [r.tmdb_id for r in df.orderBy("new_place").collect()]
    assert order(blend.apply_order(ranked, given)) == [4, 2, 8, 1, 3, 5, 6, 7]
    assert order(blend.apply_order(ranked, given.limit(2))) == list(range(1, 9))


def test_bootstrap_collapses_for_equal_users(spark):
    rows = spark.createDataFrame([("f", u, s, v) for u in (1, 2, 3) for s, v in (("a", 0.5), ("b", 0.25))], "unit string, user_id long, scorer string, m double")
    got = {r.scorer: (r.low, r.high) for r in evaluate.bootstrap(rows, "m", "b", 200).collect()}
    assert got["a"] == (0.25, 0.25) and got["b"] == (0.0, 0.0)


def test_focus_and_groups(spark):
    ranked = spark.createDataFrame([("library", 1, p, k, "movie") for p, k in enumerate((20, 10, 30))], "surface string, user_id long, place int, tmdb_id long, media_type string")
    near = spark.createDataFrame([(900, "movie", 30, "movie", 0.9), (900, "movie", 10, "movie", 0.2)], "tmdb_id long, media_type string, n_tmdb_id long, n_media_type string, sim double")
    asked = spark.createDataFrame([(7, 1, "library", 900, "movie", 1.0)], "request_id long, user_id long, surface string, seed_id long, seed_type string, weight double")
    assert [r.tmdb_id for r in serve.focus(asked, ranked, near).orderBy("new_place").collect()] == [30, 10]
    rows = serve.parse_groups(spark.createDataFrame([("1:2,3;10:11,12",), ("5:5",), ("x:1",), ("20:2",)], "map string")).collect()
    assert {(r.canonical, r.member): r.error for r in rows} == {(1, 2): "in two groups", (1, 3): None, (10, 11): None, (10, 12): None, (5, 5): "own member", (None, 1): "malformed", (20, 2): "in two groups"}


def test_rerank_by_decades_and_without_media_mix(spark):
    from tasteframe.operators import blend

    rows = [(1, i, "movie", 1.0 - i / 1000, False, 1990 if i < 5 else 2005 if i < 9 else None) for i in range(12)]
    ranked = spark.createDataFrame(rows, "user_id long, tmdb_id long, media_type string, score double, continuation boolean, year int")
    target = spark.createDataFrame([(1, 0.0)], "user_id long, target double")
    own = spark.createDataFrame([(1, 2000, 3)], "user_id long, decade int, n long")
    plain = blend.rerank(ranked.drop("year"), target, media_mix=False).orderBy("place").collect()
    assert [r.tmdb_id for r in plain] == list(range(12))
    drawn = [r.tmdb_id for r in blend.rerank(ranked, target, media_mix=False, decade_weight=0.5, own_decades=own).orderBy("place").collect()]
    assert sorted(drawn) == list(range(12))
    first = drawn.index(0)
    assert all(drawn.index(i) < first for i in range(5, 12)), drawn


def test_rank_options(spark):
    from tasteframe.operators import contexts, itemitem

    own = spark.createDataFrame([(1, 1, "movie", 2.0), (1, 2, "movie", 2.0), (1, 3, "show", 5.0)], "user_id long, tmdb_id long, media_type string, weight double")
    assert [r.tmdb_id for r in contexts.heaviest(own, 2).orderBy("tmdb_id").collect()] == [1, 3]
    assert contexts.heaviest(own, None).count() == 3
    b = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.25)], "src long, dst long, b double")
    known = spark.createDataFrame([(1, 1), (2, 1), (9, 4)], "tmdb_id long, pop long")
    cands = spark.createDataFrame([(1, 9, "movie"), (1, 8, "movie")], "user_id long, tmdb_id long, media_type string")
    plain, less = (itemitem.fold_in(own, b, known, cands, beta=beta).collect() for beta in (0.0, 0.5))
    assert [(r.tmdb_id, r.score) for r in plain] == [(9, 1.5)] and [(r.tmdb_id, r.score) for r in less] == [(9, 0.75)]


def test_documents_that_lack_parts(spark):
    from tasteframe.sources import ingest

    rows = spark.createDataFrame([("movie", '{"id": 1}'), ("show", '{"id": 2, "name": "x", "first_air_date": "", "created_by": [{"id": 5}], "origin_country": []}'), ("movie", "no json"), ("movie", None)], "media_type string, document string")
    out = {r.tmdb_id: r for r in ingest.parse_documents(rows).collect()}
    assert out[1].title is None and out[1].genres == [] and out[1].crew == [] and out[1].vote_count == 0 and out[1].certification is None
    assert out[2].title == "x" and out[2].release_date is None and out[2].year is None and out[2].crew == [5] and out[2].countries == []
    assert out[None].genres == [] and ingest.keyword_names(rows).count() == 0
