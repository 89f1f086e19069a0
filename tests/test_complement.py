"""Rankings as a complement against complete lists of all candidates."""

import random

from pyspark.sql import functions as F

from tasteframe.operators import evaluate
from tasteframe.operators.complement import Rankings
from tasteframe.plans.tables import Tables

KEYS = "tmdb_id long, media_type string"


def test_top_places_and_counts_equal_complete_lists(spark):
    rng = random.Random(6)
    titles = [(i, rng.choice(["movie", "show"])) for i in range(60)]
    users = list(range(12))
    base = [("now", s, *t, None if s == "c" or rng.random() < 0.2 else float(rng.randint(0, 9))) for s in "abc" for t in titles]
    own = [("now", u, *t) for u in users[1:] for t in rng.sample([*titles, (999, "movie")], 1 + 4 * u)]
    explicit = [("now", u, s, *t, rng.choice([None, float(rng.randint(-3, 12))])) for u in users[2:] for s in "bc" for t in rng.sample([*titles, (998, "show")], 9)]
    wanted = [("now", u, *t) for u in users for t in rng.sample(titles, 15)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    r = Rankings(frame([("now", u) for u in users], "unit string, user_id long"), frame(base, f"unit string, scorer string, {KEYS}, score double"), frame(own, f"unit string, user_id long, {KEYS}"), frame(explicit, f"unit string, user_id long, scorer string, {KEYS}, score double"), Tables.cut)
    mine, told = set(own), {e[:5]: e[5] for e in explicit}
    scores = [("now", u, s, *t, told.get(("now", u, s, *t), v)) for _, s, *t, v in base for u in users if ("now", u, *t) not in mine]
    cands = frame([("now", u, *t) for u in users for t in titles if ("now", u, *t) not in mine], f"unit string, user_id long, {KEYS}")
    complete = frame([s for s in scores if s[5] is not None], f"unit string, user_id long, scorer string, {KEYS}, score double")
    for by_type in (False, True):
        all_ = {tuple(x) for x in evaluate.lists(complete, cands, by_type).select("user_id", "scorer", "tmdb_id", "media_type", "place", "scored").collect()}
        got = {tuple(x) for x in r.top(7, by_type).select("user_id", "scorer", "tmdb_id", "media_type", "place", "scored").collect()}
        assert got == {x for x in all_ if x[4] <= 7}
        asked = {(u, *t) for _, u, *t in wanted}
        got = {tuple(x) for x in r.places(frame(wanted, f"unit string, user_id long, {KEYS}"), by_type).select("user_id", "scorer", "tmdb_id", "media_type", "place", "scored").collect()}
        assert got == {x for x in all_ if (x[0], x[2], x[3]) in asked}
    counts = {(x.user_id, x.scorer): x.scored for x in r.scored().collect()}
    assert counts == {(u, s): sum(x[0] == u and x[1] == s and x[5] for x in all_) for u in users for s in "abc"}


def test_no_product_of_users_and_titles(spark):
    """Neither lists nor places have a step whose rows are users times titles."""
    users, titles = spark.range(300), spark.range(400)
    base = titles.select(F.lit("now").alias("unit"), F.lit("s").alias("scorer"), F.col("id").alias("tmdb_id"), F.lit("movie").alias("media_type"), (F.col("id") % 50).cast("double").alias("score"))
    none = spark.createDataFrame([], f"unit string, user_id long, scorer string, {KEYS}, score double")
    people = users.select(F.lit("now").alias("unit"), F.col("id").alias("user_id"))
    r = Rankings(people, base, none.select("unit", "user_id", "tmdb_id", "media_type"), none, Tables.cut)
    top = r.top(5)
    assert top.count() == 300 * 5 and "CartesianProduct" not in top._jdf.queryExecution().executedPlan().toString()
    assert r.places(people.select("unit", "user_id", F.lit(3).cast("long").alias("tmdb_id"), F.lit("movie").alias("media_type"))).count() == 300
