"""Users meet titles without a table of users times titles."""

import glob
import math
import random
import time

from pyspark.sql import functions as F

from tasteframe.operators import baselines, blend, complement, contexts, engagement, features
from tasteframe.plans.tables import Tables

KEYS = "tmdb_id long, media_type string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_continuations_equal_a_loop_over_candidates(spark):
    rng = random.Random(3)
    items = [(k, "movie", rng.choice([0, 1, 2, 3]) or None, rng.choice([None, "1999-01-01", "2000-05-05", "2001-02-03", "2002-01-01"]), rng.choice([5.0, 7.0])) for k in range(60)]
    users, titles = range(8), [x for x in items if x[0] % 3]
    own = {(u, k) for u in (*users, 99) for k in rng.sample(range(70), 6)}  # a user without candidates, titles that items lacks
    want = set()
    for u in users:
        for c in (1, 2, 3):
            dates = [(x[3], -x[0]) for x in items if x[2] == c and x[3] and (u, x[0]) in own]
            late = [(x[3], x[0]) for x in titles if dates and x[2] == c and x[3] and x[4] >= 6 and x[3] > max(dates)[0] and (u, x[0]) not in own]
            if late:
                want.add((u, c, min(late)[1], -max(dates)[1]))
    frame = spark.createDataFrame(items, f"{KEYS}, collection_id long, release_date string, vote_average double")
    seeds = spark.createDataFrame([(u, k, "movie") for u, k in own], f"user_id long, {KEYS}")
    got = blend.continuations(seeds, spark.createDataFrame([(u,) for u in users], "user_id long"), frame.where("tmdb_id % 3 != 0"), frame)
    assert want and {(r.user_id, r.collection_id, r.tmdb_id, r.seed_id) for r in got.collect()} == want
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_pool_equals_a_loop_over_candidates(spark):
    rng = random.Random(5)
    kinds = lambda k: "movie" if k % 4 else "show"
    items = [(k, kinds(k), rng.sample(range(5), rng.randint(0, 3)), [rng.randint(0, 45) for _ in range(rng.randint(0, 6))], [rng.randint(0, 45) for _ in range(rng.randint(0, 4))]) for k in range(40)]
    users, universe, genres = range(6), {k for k in range(40) if k % 3}, {k: g for k, _, g, _, _ in items}
    recent = [(u, k, kinds(k), p, rng.choice([0.25, 0.5, 1.0])) for u in (*users, 99) for p, k in enumerate(rng.sample(range(42), 7), 1)]
    own = {(u, k) for u, k, *_ in recent} | {(u, rng.randint(0, 39)) for u in users}
    want = {}
    for u, seed, kind, _, weight in recent:
        for source, lists in ((0, 3), (1, 4)):
            entries = items[seed][lists] if seed < 40 else []
            for pos, target in enumerate(entries):
                if u in users and target in universe and kinds(target) == kind and (u, target) not in own:
                    g = genres[target]
                    share = max(0.5, 1 - len([x for x in g if x not in genres[seed]]) / len(g)) if g else 1.0
                    affinity = (1.0, 0.6)[source] * (1 - 0.5 * pos / max(1, len(entries) - 1)) * share
                    row = want.setdefault((u, target), [set(), 0.0, 0.0, None])
                    row[3] = seed if affinity * weight > row[2] * row[1] else row[3]
                    row[0].add(seed)
                    row[1:3] = max(row[1], weight), max(row[2], affinity)
    frame = spark.createDataFrame(items, f"{KEYS}, genres array<long>, recommendations array<long>, similar array<long>")
    seeds = spark.createDataFrame([(u, k, kinds(k)) for u, k in own], f"user_id long, {KEYS}")
    people, titles = spark.createDataFrame([(u,) for u in users], "user_id long"), frame.where("tmdb_id % 3 != 0").select("tmdb_id", "media_type")
    got = baselines.pool(spark.createDataFrame(recent, f"user_id long, {KEYS}, place int, weight double"), frame, people, titles, seeds)
    rows = {(r.user_id, r.tmdb_id): (r.seeds, r.max_seed_weight, round(r.affinity, 9), r.best_seed) for r in got.collect()}
    assert want and rows == {k: (len(s), w, round(a, 9), b) for k, (s, w, a, b) in want.items()}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_a_written_table_leaves_no_shuffles(spark):
    from tasteframe.plans.tables import CLEANUP

    stores = lambda: {d.getPath() for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()}
    files = lambda: {f for d in stores() for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, rows = files(), spark.range(5000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = Tables.cut(rows)
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP) == "false" and table.count() == 7


def test_remaining_titles_of_every_user(spark):
    rng = random.Random(4)
    titles = [(k, rng.choice(["movie", "show"]), rng.randint(0, 5)) for k in range(70)]
    users, own = range(9), {(u, *rng.choice(titles)[:2]) for u in range(9) for _ in range(u * u)} | {(3, 999, "movie")}
    marks = {(u, *t[:2]): u * 1.5 for u in users for t in rng.sample(titles, 5)}
    frame = spark.createDataFrame(titles, f"{KEYS}, votes int")
    mine, marked = spark.createDataFrame(list(own), f"user_id long, {KEYS}"), spark.createDataFrame([(*k, m) for k, m in marks.items()], f"user_id long, {KEYS}, mark double")
    people = spark.createDataFrame([(u, f"u{u}") for u in users], "user_id long, name string")
    order = [F.desc("votes"), F.col("media_type"), F.col("tmdb_id")]
    for by, first, after in ((None, None, 0), (None, 12, 0), (None, None, 12), ("media_type", None, 0), ("media_type", 9, 3)):
        want = set()
        for u in users:
            for kind in ("movie", "show") if by else (None,):
                rows = sorted(((k, m, v) for k, m, v in titles if (u, k, m) not in own and kind in (None, m)), key=lambda x: (-x[2], x[1], x[0]))
                want |= {(u, f"u{u}", k, m, v, p, len(rows), marks.get((u, k, m))) for p, (k, m, v) in enumerate(rows, 1) if after < p <= (first or 999)}
        got = complement.remaining(people, frame, mine, Tables.cut, ("votes",), order, by, first, after, marked, size=8)
        assert {(r.user_id, r.name, r.tmdb_id, r.media_type, r.votes, r.place, r.n, r.mark) for r in got.collect()} == want


def test_candidates_are_not_shuffled(spark):
    users, titles = spark.range(60).withColumnRenamed("id", "user_id"), spark.range(900).select(F.col("id").alias("tmdb_id"), F.lit("movie").alias("media_type"))
    own = titles.where("tmdb_id % 40 = 1").select((F.col("tmdb_id") % 60).alias("user_id"), "*")
    got = contexts.candidates(users, titles, own, Tables.cut)
    assert got.count() == 60 * 900 - own.count()
    assert plan(got).find("Generate") < plan(got).find("Exchange")  # the product is made above every exchange


def test_titles_of_one_name_meet_once(spark):
    rng = random.Random(2)
    rows = lambda n: [(k, rng.choice(["movie", "show"]), rng.choice(["One", "oNE", "Two", None]), rng.choice([None, 1990, 1991, 1992, 1994])) for k in range(n)]
    titles, found = rows(60), [(*x, rng.choice([None, 10, 20, 30])) for x in rows(50)]
    schema = "media_type string, title string, year int"
    want = {}
    for k, kind, name, year in titles:
        fits = [(1 if v is None else 2, -(v or 0), i) for i, m, n, y, v in found if m == kind and name and n and n.lower() == name.lower() and (year is None or y is None or abs(year - y) <= 1)]
        if fits:
            want[k, kind] = min(fits)[2]
    resolved = engagement.resolve_titles(spark.createDataFrame(titles, f"rating_key long, {schema}"), spark.createDataFrame(found, f"tmdb_id long, {schema}, vote_count long"))
    assert want and {(r.rating_key, r.media_type): r.tmdb_id for r in resolved.collect()} == want
    many = spark.range(3000).select(F.col("id").alias("tmdb_id"), F.lit("movie").alias("media_type"), F.lit("same").alias("title"), F.lit(1990).alias("year"), F.col("id").alias("vote_count"))
    met = engagement.resolve_titles(many.withColumnRenamed("tmdb_id", "rating_key"), many)
    assert {r.tmdb_id for r in met.collect()} == {2999}
    joins = met._jdf.queryExecution().executedPlan().toString()
    assert "kind" in joins and "year_" not in joins  # no pair of titles is judged by its years


def test_fused_candidates_equal_the_plain_blend(spark):
    rng = random.Random(7)
    titles = [(k, rng.choice(["movie", "show"]), float(rng.randint(0, 6))) for k in range(50)]
    users, own = range(6), {(u, *rng.choice(titles)[:2]) for u in range(6) for _ in range(3 * u)}
    pool = [("pool", u, k, m, float(rng.randint(0, 9))) for u in users for k, m, _ in rng.sample(titles, 12) if (u, k, m) not in own]
    nexts = [(u, k, m) for u in users for k, m, _ in rng.sample(titles, 4) if (u, k, m) not in own]
    scores = [("votes", u, *t) for u in users for t in titles if (u, *t[:2]) not in own] + pool
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    kind = f"component string, user_id long, {KEYS}, score double"
    for ws in (((1.0, 1.0), (2.0, 0.5)), ((1.0, 0.0), (0.0, 3.0))):
        weights = frame([(c, m, w) for c, w2 in zip(("votes", "pool"), ws, strict=True) for m, w in zip(("movie", "show"), w2, strict=True)], "component string, media_type string, weight double")
        want = blend.with_bonus(blend.fuse(frame(scores, kind), weights), frame(nexts, f"user_id long, {KEYS}"))
        got = blend.fuse_candidates(frame([(u,) for u in users], "user_id long"), frame(titles, f"{KEYS}, score double"), frame(list(own), f"user_id long, {KEYS}"), frame(pool, kind), weights, Tables.cut, "votes", frame(nexts, f"user_id long, {KEYS}"))
        rows = lambda df: {(r.user_id, r.tmdb_id, r.media_type, r.continuation, round(r.score, 9)) for r in df.collect()}
        assert rows(got) == rows(want)


def test_nearest_own_titles(spark):
    rng = random.Random(8)
    space = {k: {f"t{j}": rng.choice([0.25, 0.5, 0.75]) for j in rng.sample(range(12), rng.randint(1, 4))} for k in range(40)}
    kind = lambda k: "movie" if k % 3 else "show"
    listed, own = [(u, k, kind(k)) for u in range(5) for k in rng.sample(range(45), 20)], [(u, k, kind(k)) for u in range(1, 6) for k in rng.sample(range(45), 9)]
    want = set()
    for u, k, m in listed:
        sims = [(-round(sum(w * space[s].get(t, 0) for t, w in space[k].items()), 9), n, s) for v, s, n in own if v == u and k in space and s in space]
        want |= {(u, k, m, i, s, n) for i, (sim, n, s) in enumerate(sorted(sims)[:3], 1) if sim < 0}
    rows = spark.createDataFrame([(k, kind(k), t, w) for k, v in space.items() for t, w in v.items()], f"{KEYS}, term string, w double")
    got = features.nearest_own(spark.createDataFrame(listed, f"user_id long, {KEYS}"), spark.createDataFrame(own, f"user_id long, {KEYS}"), rows, 3)
    assert want and {tuple(r) for r in got.collect()} == want


def test_content_profiles_equal_a_loop_and_shuffle_no_candidates(spark):
    rng = random.Random(9)
    items = [(k, "movie", rng.sample(range(4), rng.randint(0, 2)), rng.sample(range(9), rng.randint(0, 3))) for k in range(60)]
    users, own = range(5), {(u, k): rng.choice([0.5, 1.0]) for u in range(4) for k in rng.sample(range(60), 4)}
    terms = {k: [f"g{x}" for x in g] + [f"k{x}" for x in w] for k, _, g, w in items}
    value = {t: math.log(len(items) / sum(t in x for x in terms.values())) for x in terms.values() for t in x}
    unit = {k: {t: value[t] / math.sqrt(sum(value[s] ** 2 for s in x)) for t in x} for k, x in terms.items()}
    want = {}
    for u in users:
        profile = {}
        for (v, k), w in own.items():
            for t, x in unit[k].items() if v == u else ():
                profile[t] = profile.get(t, 0) + w * x
        norm = math.sqrt(sum(p * p for p in profile.values())) or 1.0
        want |= {(u, k): round(sum(profile.get(t, 0) * x for t, x in unit[k].items()) / norm, 9) for k in unit if k % 2 and unit[k] and (u, k) not in own}
    frame = spark.createDataFrame(items, f"{KEYS}, genres array<long>, keywords array<long>")
    seeds = spark.createDataFrame([(u, k, "movie", w) for (u, k), w in own.items()], f"user_id long, {KEYS}, weight double")
    got = baselines.content_profile(seeds, frame, spark.createDataFrame([(u,) for u in users], "user_id long"), frame.where("tmdb_id % 2 = 1"), seeds, Tables.cut)
    assert {(r.user_id, r.tmdb_id): round(r.score, 9) for r in got.collect()} == want
    assert plan(got).find("Generate") < plan(got).find("Exchange")


def test_vectors_travel_as_they_are_stored(spark):
    rows = [(k, "movie", [float(k % 7 - 3), float(k % 5), 1.0]) for k in range(90)]
    vectors = spark.createDataFrame(rows, f"{KEYS}, embedding array<float>")
    got = features.dense_similarity(vectors, vectors, vectors, size=40)
    unit = {k: [x / max(math.sqrt(sum(y * y for y in v)), 1e-9) for x in v] for k, _, v in rows}
    assert {(r.tmdb_id, r.n_tmdb_id): round(r.sim, 9) + 0.0 for r in got.collect()} == {(a, b): round(sum(x * y for x, y in zip(unit[a], unit[b], strict=True)), 9) + 0.0 for a in unit for b in unit}
    dealt = got._jdf.queryExecution().optimizedPlan().children().head().children().head()
    assert "array<float>" in dealt.schema().simpleString() and "CoGroup" not in plan(got)
