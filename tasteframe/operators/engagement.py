"""From plays to one engagement row per user and title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteframe.functions import scalars as S
from tasteframe.functions.scalars import KEY


def canonical_user(rows: DataFrame, alias: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows with a member account's user replaced by the canonical one; the map is small, so the rows stay where they are."""
    joined = rows.join(F.broadcast(alias.select(F.col("member").alias("member_"), F.col("canonical").alias("canonical_"))), F.col(user) == F.col("member_"), "left")
    return joined.withColumn(user, F.coalesce("canonical_", user)).drop("member_", "canonical_")


def engagements(plays: DataFrame, titles: DataFrame, alias: DataFrame, now: int) -> DataFrame:
    """Plays joined to titles and summed by (user, title), with level and label."""
    t = titles.where(F.col("tmdb_id").isNotNull()).select(F.col("rating_key").alias("key_"), "tmdb_id", F.col("media_type").alias("kind"))
    narrow = plays.select("user_id", F.coalesce("grandparent_rating_key", "rating_key").alias("key_"), "rating_key", "date", "watched_status", "percent_complete", S.shared_screen().cast("double").alias("screen"))
    rows = canonical_user(narrow, alias).join(t, "key_").drop("key_").withColumnRenamed("kind", "media_type")
    rows = rows.repartition("user_id", "tmdb_id", "media_type")  # one shuffle serves the plain and the distinct count
    done = F.col("watched_status") == 1
    out = rows.groupBy("user_id", "tmdb_id", "media_type").agg(
        F.coalesce(F.min(F.when(done, F.col("date"))), F.min("date")).alias("first_at"),
        F.max("date").alias("last_at"),
        F.coalesce(F.sum(done.cast("long")), F.lit(0)).alias("completed_plays"),
        F.countDistinct(F.when(done, F.col("rating_key"))).alias("distinct_episodes"),
        F.max("percent_complete").alias("max_percent"),
        F.avg("screen").alias("tv_share"),
    )
    level, label = S.engagement("media_type", "completed_plays", "distinct_episodes", "max_percent", "last_at", now)
    return out.withColumns({"engagement": level.cast("double"), "label": label})


def completed_per_user(plays: DataFrame, users: DataFrame, least: int = 100) -> DataFrame:
    """D3, B1: completed plays of every user, and whether there are more than `least`."""
    n = plays.where("watched_status = 1").groupBy("user_id").agg(F.count(F.lit(1)).alias("completed_plays"))
    out = users.select("user_id").distinct().join(n, "user_id", "left").na.fill(0, ["completed_plays"])
    return out.withColumn("evaluated", F.col("completed_plays") > least)


def history_titles(plays: DataFrame) -> DataFrame:
    """The titles that plays speak of: movies by their key, shows by their parent's."""
    movies = plays.where("media_type = 'movie'").groupBy("rating_key").agg(F.lit("movie").alias("media_type"), F.max("title").alias("title"), F.max("year").alias("year"))
    aired = F.min(F.substring("originally_available_at", 1, 4)).try_cast("int")
    shows = plays.where("media_type = 'episode' and grandparent_rating_key is not null").groupBy(F.col("grandparent_rating_key").alias("rating_key"))
    return movies.unionByName(shows.agg(F.lit("show").alias("media_type"), F.max("grandparent_title").alias("title"), aired.alias("year")))


def label_counts(engaged: DataFrame) -> DataFrame:
    """Positives by kind, and weak negatives, per user."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    positive = F.col("label") == "positive"
    return engaged.groupBy("user_id").agg(
        count(positive & (F.col("media_type") == "movie"))("movies"), count(positive & (F.col("media_type") == "show"))("shows"), count(F.col("label") == "weak_negative")("weak_negatives")
    )


def unresolved_share(plays: DataFrame, titles: DataFrame, most: float = 0.05) -> DataFrame:
    """The share of a user's completed plays whose title has no id, and whether it is over `most`."""
    t = titles.select(F.col("rating_key").alias("key_"), "tmdb_id")
    rows = plays.where("watched_status = 1").withColumn("key_", F.coalesce("grandparent_rating_key", "rating_key")).join(t, "key_", "left")
    out = rows.groupBy("user_id").agg(F.avg(F.col("tmdb_id").isNull().cast("double")).alias("unresolved"))
    return out.withColumn("flagged", F.col("unresolved") > most)


def households(engaged: DataFrame, items: DataFrame, users: DataFrame, now: int, days: int = 365) -> DataFrame:
    """An account's positive titles of the last year, the children's among them, and the label."""
    recent = engaged.where((F.col("label") == "positive") & (F.col("last_at") >= now - days * S.DAY))
    marked = recent.join(items.select(*KEY, S.is_kids().cast("long").alias("kids")), KEY)
    n = marked.groupBy("user_id").agg(F.count(F.lit(1)).alias("window_titles"), F.sum("kids").alias("kids_titles"))
    out = users.select("user_id").distinct().join(n, "user_id", "left").na.fill(0, ["window_titles", "kids_titles"])
    share = F.when(F.col("window_titles") > 0, F.col("kids_titles") / F.col("window_titles")).otherwise(0.0)
    return out.withColumns({"kids_share": share, "label": S.household_label(F.col("window_titles"), F.col("kids_titles"))})


def resolve_titles(titles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """C14: titles matched to the catalogue by type and lower-case name, years at most one apart (any, if unknown), the
    most voted first. Of catalogue titles of one name and year only the best can be found, so a title meets a row for each
    of the years that are near, and the best of all years where one is unknown; not every title of its name."""
    best = F.min_by(F.struct("vote_count", "found"), F.struct(-F.col("vote_count"), "found"))
    c = catalogue.select(F.col("media_type").alias("kind"), F.lower("title").alias("name"), "year", F.col("tmdb_id").alias("found"), "vote_count")
    by_year = c.groupBy("kind", "name", "year").agg(best.alias("best"))
    whole = by_year.select("kind", "name", "best.*").groupBy("kind", "name").agg(best.alias("best"))
    around = F.array(*(F.col("year").cast("int") + d for d in (-1, 0, 1)))
    dated, undated = by_year.where("year is not null"), by_year.where("year is null")
    near = dated.select("kind", "name", F.explode(around).alias("near"), "best").groupBy("kind", "name", "near").agg(F.min_by("best", F.struct(-F.col("best.vote_count"), "best.found")).alias("best"))
    titles = titles.select("rating_key", F.col("media_type").alias("kind"), F.lower("title").alias("name"), F.col("year").cast("int").alias("near"))
    offers = titles.where("near is null").join(whole, ["kind", "name"]).select("rating_key", "kind", "best")
    offers = offers.unionByName(titles.where("near is not null").join(near, ["kind", "name", "near"]).select("rating_key", "kind", "best"))
    offers = offers.unionByName(titles.where("near is not null").join(undated.select("kind", "name", "best"), ["kind", "name"]).select("rating_key", "kind", "best"))
    return offers.groupBy("rating_key", F.col("kind").alias("media_type")).agg(F.min_by("best.found", F.struct(-F.col("best.vote_count"), "best.found")).alias("tmdb_id"))


#: Fixed value: how an external id stands in a list of identifiers.
EXTERNAL = "tmdb://"


def title_sources(titles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """C14: the id of every title, and where it is from: the first identifier of its list `guids` that has the prefix, else
    the match by name, else none."""
    named = F.get(F.filter("guids", lambda g: g.startswith(EXTERNAL)), F.lit(0))
    given = titles.select("rating_key", "media_type", "title", "year", F.substring(named, len(EXTERNAL) + 1, 20).try_cast("bigint").alias("given"))
    matched = resolve_titles(given.where("given is null"), catalogue)
    rows = given.join(matched, ["rating_key", "media_type"], "left")
    source = F.when(F.col("given").isNotNull(), "identifier").when(F.col("tmdb_id").isNotNull(), "name").otherwise("unresolved")
    return rows.select("rating_key", "media_type", F.coalesce("given", "tmdb_id").alias("tmdb_id"), source.alias("source"))
