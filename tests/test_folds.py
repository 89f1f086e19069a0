"""All folds in one pass against one fold at a time, and a grid against its settings."""

import random

from pyspark.sql import functions as F

from tasteframe.operators import content, itemitem, pagerank
from tasteframe.plans import folds
from tasteframe.plans.tables import Tables

KEYS = "tmdb_id long, media_type string"


def world(spark):
    rng = random.Random(3)
    titles = [(i, "movie" if i % 4 else "show") for i in range(40)]
    space = spark.createDataFrame([(*t, f"t{j}", rng.random() / 3) for t in titles for j in rng.sample(range(25), 6)], f"{KEYS}, term string, w double")
    items = spark.createDataFrame([(*t, rng.randint(0, 900)) for t in titles], f"{KEYS}, vote_count long")
    walkers = [(f, u) for f in (0, 3) for u in range(5)]
    own = {w: rng.sample(titles, rng.randint(1, 9)) for w in walkers}
    dropped = [(*w, *t) for w in walkers[:7] for t in rng.sample([t for t in titles if t not in own[w]], 3)]
    seeds = [(*w, *t, rng.random()) for w, ts in own.items() for t in ts]
    cands = [(*w, *t) for w in walkers for t in titles if t not in own[w]]
    frame = lambda rows, more="": spark.createDataFrame(rows, f"fold_id int, user_id long, {KEYS}{more}")
    return space, items, frame(seeds, ", weight double"), frame(dropped), frame(cands)


def test_one_pass_equals_fold_by_fold(spark):
    space, items, own, dropped, cands = world(spark)
    b = spark.createDataFrame([(i, (i * 7 + 3) % 40, 0.1 * i - 1) for i in range(40) if i % 4], "src long, dst long, b double")
    modelled = b.selectExpr("src AS tmdb_id").distinct()
    one = lambda df, f: df.where(f"fold_id = {f}").drop("fold_id")
    w = folds.walkers
    key = lambda rows: {(r.user_id, r.tmdb_id, r.media_type): round(r.score, 9) for r in rows}
    knn = folds.of_folds(content.seed_knn(space, w(own), w(dropped), w(cands), items)).collect()
    sums = folds.of_folds(itemitem.fold_in(w(own), b, modelled, w(cands))).collect()
    for f in (0, 3):
        assert key(r for r in knn if r.unit == str(f)) == key(content.seed_knn(space, one(own, f), one(dropped, f), one(cands, f), items).collect())
        assert key(r for r in sums if r.unit == str(f)) == key(itemitem.fold_in(one(own, f), b, modelled, one(cands, f)).collect())


def test_grid_equals_its_settings(spark):
    space, items, own, dropped, cands = (Tables.cut(x) for x in world(spark))
    one = lambda df: df.where("fold_id = 0").drop("fold_id")
    grid = {"a": content.Setting(), "b": content.Setting(2, 1.0, 0.5), "c": content.Setting(3, 3.0, 0.0, 0.25), "d": content.Setting(3, negative_weight=0.0)}
    got = {}
    for r in content.settings(space, one(own), one(dropped), one(cands), items, grid).collect():
        got.setdefault(r.scorer, {})[r.user_id, r.tmdb_id, r.media_type] = round(r.score, 6)
    for name, s in grid.items():
        want = content.seed_knn(space, one(own), one(dropped), one(cands), items, s.m, s.p, s.negative_weight, s.pop_power).collect()
        assert got[name] == {(r.user_id, r.tmdb_id, r.media_type): round(r.score, 6) for r in want}
    # without other media: the same where a user has a seed of the type; elsewhere the grid says 0, the scorer nothing
    own_media = content.settings(space, one(own), one(dropped), one(cands), items, {"x": content.Setting(cross_media=False)}).collect()
    want = {(r.user_id, r.tmdb_id, r.media_type): round(r.score, 6) for r in content.seed_knn(space, one(own), one(dropped), one(cands), items, cross_media=False).collect()}
    got = {(r.user_id, r.tmdb_id, r.media_type): round(r.score, 6) for r in own_media}
    assert want and all(got[k] == v for k, v in want.items()) and not any(v for k, v in got.items() if k not in want)


def test_graph_and_item_grids_equal_their_settings(spark):
    space, items, own, _, cands = (Tables.cut(x) for x in world(spark))
    one = lambda df: df.where("fold_id = 0").drop("fold_id")
    key = lambda rows: {(r.user_id, r.tmdb_id, r.media_type): round(r.score, 7) for r in rows}
    listed = items.withColumns({"genres": F.array(F.lit(1)), "recommendations": F.array(*((F.col("tmdb_id") * k + 1) % 43 for k in (1, 3))), "similar": F.array((F.col("tmdb_id") * 5) % 41)})
    got = pagerank.settings(listed, one(own), one(cands), Tables.cut, {"x": (0.5, 2.0), "y": (1.0, 1.0)}, rounds=4, global_rounds=5).collect()
    for name, beta, pop in (("x", 0.5, 2.0), ("y", 1.0, 1.0)):
        assert key(r for r in got if r.scorer == name) == key(pagerank.personal_rank(listed, one(own), one(cands), Tables.cut, rounds=4, global_rounds=5, beta=beta, pop_power=pop).collect())
    b = spark.createDataFrame([(i, (i * 7 + 3) % 40, 0.1 * i - 1) for i in range(40) if i % 4], "src long, dst long, b double")
    modelled = b.selectExpr("src AS tmdb_id", "src + 1 AS pop").distinct()
    got = itemitem.settings(one(own), {"b": b}, modelled, one(cands), (0.0, 0.5)).collect()
    for name, beta in (("b_beta0", 0.0), ("b_beta0.5", 0.5)):
        assert key(r for r in got if r.scorer == name) == key(itemitem.fold_in(one(own), b, modelled, one(cands), beta=beta).collect())
