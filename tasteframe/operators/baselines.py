"""Simple scorers: popularity, co-listing of recent seeds, one content profile."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasteframe.functions import scalars as S
from tasteframe.functions.scalars import KEY
from tasteframe.operators.complement import remaining
from tasteframe.operators.contexts import candidates
from tasteframe.operators.features import tfidf


def recent_seeds(own: DataFrame, cutoff: Column, most: int = 30, length: float = 45.0) -> DataFrame:
    """A user's latest titles with place and weight: if both types are there, ten of each come first (the type
    of the latest seed before the other), then the latest of the rest, thirty in all."""
    at = F.least(F.col("last_at"), cutoff)
    rows = own.withColumn("at", at)
    by_user, by_type = Window.partitionBy("user_id"), Window.partitionBy("user_id", "media_type")
    latest = [F.desc("at"), "media_type", "tmdb_id"]
    rows = rows.withColumns({
        "in_type": F.row_number().over(by_type.orderBy(*latest)),
        "overall": F.row_number().over(by_user.orderBy(*latest)),
        "types": F.size(F.collect_set("media_type").over(by_user)),
    }).withColumn("type_first", F.min("overall").over(by_type))
    quota = (F.col("types") > 1) & (F.col("in_type") <= most // 3)
    order = F.row_number().over(by_user.orderBy(F.when(quota, 0).otherwise(1), F.when(quota, F.col("type_first")).otherwise(0), "overall"))
    rows = rows.withColumn("place", order).where(F.col("place") <= most)
    return rows.select("user_id", *KEY, "place", S.half_life((cutoff - F.col("at")) / F.lit(S.DAY), length).alias("weight"))


def listed(items: DataFrame) -> DataFrame:
    """The entries of items' lists: source 0 (recommendations) or 1 (similar), place, length and target."""
    one = lambda c, s: items.select(*KEY, "genres", F.lit(s).alias("source"), F.size(c).alias("length"), F.posexplode(c).alias("pos", "target"))
    return one("recommendations", 0).unionByName(one("similar", 1))


def pool(recent: DataFrame, items: DataFrame, users: DataFrame, titles: DataFrame, own: DataFrame) -> DataFrame:
    """Titles of the universe listed by a user's recent seeds, but their own: number of seeds, largest seed weight,
    largest affinity, and the best seed: the one of the last entry whose product exceeds that of the two maxima before it.
    Entries of lists that lead out of the universe go, and affinities are computed, before users meet the lists."""
    targets = titles.select(*KEY).join(items.select(*KEY, "genres"), KEY).withColumnsRenamed({"tmdb_id": "target"})
    lists = listed(items).withColumnsRenamed({"genres": "seed_genres"}).join(targets, ["target", "media_type"])
    affinity = F.when(F.col("source") == 0, 1.0).otherwise(0.6) * S.position_decay(F.col("pos"), F.col("length")) * S.genre_coherence(F.col("genres"), F.col("seed_genres"))
    lists = lists.select(*KEY, "target", "source", "pos", affinity.alias("affinity"))
    hits = recent.join(users.select("user_id").distinct(), "user_id", "left_semi").join(lists, KEY).select("user_id", F.col("tmdb_id").alias("seed_id"), "media_type", "place", "weight", "source", "pos", "affinity", F.col("target").alias("tmdb_id"))
    hits = hits.join(own.select("user_id", *KEY), ["user_id", *KEY], "left_anti")
    order = F.struct("place", "source", "pos")
    before = Window.partitionBy("user_id", *KEY).orderBy("place", "source", "pos").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("order", order)
    top = lambda c: F.coalesce(F.max(c).over(before), F.lit(0.0))
    hits = hits.withColumn("better", F.col("affinity") * F.col("weight") > top("affinity") * top("weight"))
    return hits.groupBy("user_id", *KEY).agg(
        F.countDistinct("seed_id").alias("seeds"),
        F.max("weight").alias("max_seed_weight"),
        F.max("affinity").alias("affinity"),
        F.max_by("seed_id", F.when(F.col("better"), F.col("order"))).alias("best_seed"),
    )


def demand_order(pools: DataFrame, items: DataFrame) -> DataFrame:
    """The demand-sorted inbox: place from 1 among a user's gated titles."""
    demand = pools.groupBy(*KEY).agg(F.countDistinct("user_id").alias("demand"))
    votes = F.when(F.col("media_type") == "movie", 500).otherwise(180)
    good = items.where((F.col("vote_average") >= 7.0) & (F.col("vote_count") >= votes) & (F.coalesce("year", F.lit(0)) >= 1969))
    rows = pools.select("user_id", *KEY).join(good.select(*KEY, "vote_average", "vote_count"), KEY).join(demand, KEY)
    order = Window.partitionBy("user_id").orderBy(F.desc("demand"), F.desc("vote_average"), F.desc("vote_count"), "media_type", "tmdb_id")
    return rows.select("user_id", *KEY, "demand", F.row_number().over(order).alias("place"))


def row_ranking(pools: DataFrame, items: DataFrame, cutoff_year: float) -> DataFrame:
    """Pool entries by score, then one title of each seed in turn, seeds by their best title."""
    rows = pools.join(items.select(*KEY, "vote_average", "vote_count", "year"), KEY)
    rating = F.when(F.col("vote_count") != 0, F.col("vote_average")).otherwise(5.0)
    age = F.when(F.col("year") != 0, F.greatest(F.lit(0.0), F.lit(cutoff_year) - F.col("year"))).otherwise(0.0)
    score = (1 + F.col("seeds")) * rating * (1 + F.col("max_seed_weight")) * F.col("affinity") * S.half_life(age, 16.0)
    rows = rows.withColumn("score", score)
    by_seed = Window.partitionBy("user_id", "media_type", "best_seed").orderBy(F.desc("score"), "media_type", "tmdb_id")
    rows = rows.withColumns({"turn": F.row_number().over(by_seed), "best": F.max("score").over(Window.partitionBy("user_id", "media_type", "best_seed"))})
    order = Window.partitionBy("user_id").orderBy("turn", F.desc("best"), "media_type", "best_seed")
    return rows.select("user_id", *KEY, "score", F.row_number().over(order).alias("place"))


def global_popularity(users: DataFrame, titles: DataFrame, own: DataFrame, items: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Votes, which the titles carry before users meet them."""
    rated = titles.select(*KEY).join(items.select(*KEY, F.col("vote_count").cast("double").alias("score")), KEY)
    return candidates(users, rated, own, cut, ("score",))


def household_popularity(demand: DataFrame, items: DataFrame) -> DataFrame:
    """I4: what others wanted, then votes."""
    return demand.join(items.select(*KEY, "vote_count"), KEY).select("user_id", *KEY, (F.col("demand") * 1e9 + F.col("vote_count")).alias("score"))


def content_profile(own: DataFrame, items: DataFrame, users: DataFrame, titles: DataFrame, seen: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cosine of a candidate (a title that is not `seen`) with the weighted sum of the vectors of genres and keywords of
    `own`. A user's profile is one row, a title carries its few terms, and each candidate's sum is made where it is."""
    named = lambda p, c: F.transform(c, lambda x: F.concat(F.lit(p), x.cast("string")))
    space = tfidf(items, F.array_distinct(F.concat(named("g", "genres"), named("k", "keywords"))), weighted=False)
    numbers = space.select("term").distinct().withColumn("t", F.row_number().over(Window.orderBy("term")))  # a narrow row a term
    space = cut(space.join(numbers, "term"))
    profile = own.select("user_id", *KEY, "weight").join(space, KEY).groupBy("user_id", "t").agg(F.sum(F.col("weight") * F.col("w")).alias("p"))
    profile = profile.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "p"))).alias("e"), F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    people = users.select("user_id").distinct().join(profile.select("user_id", F.col("e.t").alias("ts"), F.col("e.p").alias("ps"), "norm"), "user_id", "left")
    terms = space.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("terms"))
    known = titles.select(*KEY).join(items.where("size(genres) + size(keywords) > 0").select(*KEY), KEY, "left_semi").join(terms, KEY, "left")
    rows = remaining(people, known, seen, cut, ("terms",))
    dot = F.aggregate("terms", F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.get("ps", (F.array_position("ts", x["t"]) - 1).cast("int")), F.lit(0.0)))
    return rows.select("user_id", *KEY, F.coalesce(dot / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), F.lit(0.0)).alias("score"))
