"""Answering requests from ranked lists, as a table-to-table job.

Ranked lists: (surface, user_id, place from 0, key, votes, kids, genres, why); requests as in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasteframe.functions.scalars import KEY, genre_ids
from tasteframe.operators.engagement import canonical_user

#: Why a title is dropped; the first that holds counts.
REASONS = ("other_media", "not_in_these_libraries", "not_in_season", "in_library", "excluded", "excluded_genre", "over_limit")

#: The lists there are, and how many titles of a type a request gets that names no number.
SURFACES, DEFAULT_LIMIT = ("missing", "library"), 200


def requested(requests: DataFrame) -> DataFrame:
    """Requests as they arrive, with what they leave open filled in: both types, 200 titles a type, no genres.
    Genres are named, in any case; unknown names go. A season without any type is none, one with an empty type is kept.
    A surface that is not known, or null, is an `error`; no list answers it."""
    known = F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False))
    return requests.withColumns({
        "media": F.when(F.size("media") > 0, F.col("media")).otherwise(F.array(F.lit("movie"), F.lit("show"))),
        "limit_per_media": F.coalesce(F.nullif("limit_per_media", F.lit(0)), F.lit(DEFAULT_LIMIT)),
        "season": F.when(F.size(F.map_keys("season")) > 0, F.col("season")),
        "excluded_genres": genre_ids(F.coalesce("excluded_genres", F.array().cast("array<string>"))),
        "error": F.when(~known, F.concat(F.lit("unknown surface "), F.coalesce("surface", F.lit("null")))),
    })


def answer(requests: DataFrame, ranked: DataFrame, alias: DataFrame) -> DataFrame:
    """A row per request and listed title, with the first reason against it (null: returned). Only titles that
    meet every other rule count to the limit per type."""
    asked = canonical_user(requests.withColumnRenamed("account_id", "user_id"), alias)
    rows = asked.join(ranked, ["user_id", "surface"])
    of = lambda m: F.coalesce(F.try_element_at(m, F.col("media_type")), F.array().cast("array<bigint>"))
    inside = lambda m: F.array_contains(of(m), F.col("tmdb_id"))
    any_library = F.coalesce(F.size(F.map_keys("library")), F.lit(0)) > 0
    excluded = F.exists(F.coalesce("exclude", F.array().cast("array<struct<tmdb_id:bigint,media_type:string>>")), lambda x: (x["tmdb_id"] == F.col("tmdb_id")) & (x["media_type"] == F.col("media_type")))
    library = F.coalesce("library", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<bigint>>")))
    fate = (
        F.when(~F.array_contains("media", F.col("media_type")), REASONS[0])
        .when((F.col("surface") == "library") & any_library & ~inside(library), REASONS[1])
        .when(F.col("season").isNotNull() & ~inside(F.col("season")), REASONS[2])
        .when((F.col("surface") == "missing") & inside(library), REASONS[3])
        .when(excluded, REASONS[4])
        .when(F.coalesce(F.arrays_overlap("excluded_genres", "genres"), F.lit(False)), REASONS[5])
    )
    rows = rows.withColumn("fate", fate)
    nth = F.sum(F.col("fate").isNull().cast("int")).over(Window.partitionBy("request_id", "media_type").orderBy("place"))
    over = F.col("fate").isNull() & (nth > F.col("limit_per_media"))
    return rows.withColumn("fate", F.when(over, REASONS[6]).otherwise(F.col("fate"))).select("request_id", "user_id", "surface", "place", *KEY, "fate")


def trace(answered: DataFrame) -> DataFrame:
    """K2: per request the ranked and returned titles, and those dropped by reason."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return answered.groupBy("request_id").agg(F.count(F.lit(1)).alias("ranked"), one(F.col("fate").isNull()).alias("returned"), *(one(F.col("fate") == r).alias(r) for r in REASONS))


def focus(requests: DataFrame, ranked: DataFrame, near: DataFrame) -> DataFrame:
    """K3: lists re-ranked by closeness to a few seeds: sum of weight x similarity, halved towards the list's end; titles
    like none of the seeds go; the seed that adds most explains. requests: (request_id, user_id, surface, seed_id,
    seed_type, weight)."""
    pairs = near.select(F.col("tmdb_id").alias("seed_id"), F.col("media_type").alias("seed_type"), F.col("n_tmdb_id").alias("tmdb_id"), F.col("n_media_type").alias("media_type"), "sim")
    hits = requests.join(pairs, ["seed_id", "seed_type"]).withColumn("v", F.col("weight") * F.col("sim"))
    sums = hits.groupBy("request_id", "user_id", "surface", *KEY).agg(F.sum("v").alias("near"), F.min_by("seed_id", F.struct(-F.col("v"), "seed_type", "seed_id")).alias("seed_id"))
    size = ranked.groupBy("surface", "user_id").agg(F.count(F.lit(1)).alias("size"))
    rows = ranked.join(sums, ["surface", "user_id", *KEY]).join(size, ["surface", "user_id"])
    score = F.col("near") * (0.5 + 0.5 * (1 - F.col("place") / F.greatest("size", F.lit(1))))
    order = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("score"), "place"))
    return rows.withColumn("score", score).select("request_id", *KEY, "score", "seed_id", order.alias("new_place"))


def first_titles(ranked: DataFrame, family: str, limit: int) -> DataFrame:
    """The first titles of every list, without or with only children's titles."""
    rows = {"exclude": ranked.where("not kids"), "only": ranked.where("kids")}.get(family, ranked)
    n = F.row_number().over(Window.partitionBy("surface", "user_id").orderBy("place"))
    return rows.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def parse_groups(maps: DataFrame, text: str = "map", by: tuple[str, ...] = ()) -> DataFrame:
    """K4: account maps `canonical:member,member;...` as (by, part, canonical, member, error); error names what is wrong.
    Rows of equal `by` are one map, all rows without it. An id is plain digits, above zero: no sign, no other script. A
    map with any error is to be refused; blank parts are none."""
    account = lambda c: F.when(F.trim(c).rlike("^[0-9]+$"), F.nullif(F.trim(c).try_cast("bigint"), F.lit(0)))
    groups = maps.select(*by, F.posexplode(F.split(F.col(text), ";")).alias("group", "part"), F.hash(text).alias("from_")).where("trim(part) != ''")
    sides = groups.select(*by, "group", "from_", F.trim("part").alias("part"), F.split("part", ":").alias("s"))
    tail = F.coalesce(F.try_element_at("s", F.lit(2)), F.lit(""))
    rows = sides.select(*by, "group", "from_", "part", F.size("s").alias("n"), (F.trim(tail) == "").alias("bare"), account(F.col("s")[0]).alias("canonical"), F.explode(F.split(tail, ",")).alias("m"))
    rows = rows.withColumn("member", account(F.col("m")))
    rows = rows.withColumns({
        "times": F.count(F.lit(1)).over(Window.partitionBy(*by, "member")),
        "groups": F.size(F.collect_set(F.struct("from_", "group")).over(Window.partitionBy(*by, "canonical"))),
    })
    named = rows.select(*by, F.col("canonical").alias("member"), F.lit(True).alias("elsewhere")).distinct()
    rows = rows.join(named, [*by, "member"], "left")
    error = (
        F.when((F.col("n") != 2) | F.col("canonical").isNull() | (F.col("member").isNull() & ~F.col("bare")), "malformed")
        .when(F.col("bare"), "no members")
        .when(F.col("canonical") == F.col("member"), "own member")
        .when(F.col("times") > 1, "in two groups")
        .when(F.col("groups") > 1, "canonical of two groups")
        .when(F.col("elsewhere"), "canonical elsewhere")
    )
    return rows.select(*by, "part", "canonical", "member", error.alias("error"))


def normal_form(alias: DataFrame) -> DataFrame:
    """K4: each group's text with sorted members."""
    members = F.sort_array(F.collect_set("member"))
    return alias.groupBy("canonical").agg(F.concat(F.col("canonical").cast("string"), F.lit(":"), F.array_join(members.cast("array<string>"), ",")).alias("text"))
