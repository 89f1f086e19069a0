"""Sources and sinks: play logs, libraries, requests, catalogue documents, ratings; derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasteframe.functions.scalars import KEY


def newest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows that share a key, the newest by the given order."""
    at = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("newest_", F.row_number().over(at)).where("newest_ = 1").drop("newest_")


def load_plays(records: DataFrame, key: str = "row_id", order: tuple[str, ...] = ("date",)) -> DataFrame:
    """A1: plays of movies and episodes; ids 0 and empty texts are null; the newest record of a row wins."""
    rows = records.where(F.col("media_type").isin("movie", "episode"))
    falsy = {c: F.nullif(F.col(c), F.lit("") if t == "string" else F.lit(0)) for c, t in records.dtypes if c in ("rating_key", "grandparent_rating_key", "title", "player", "platform", "product")}
    return newest(rows.withColumns(falsy), [key], *(F.struct(*order, *[c for c in rows.columns if c not in order]),))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """A2: incoming rows replace stored ones of the same key."""
    return stored.join(incoming, keys, "left_anti").unionByName(incoming)


def load_library(rows: DataFrame) -> DataFrame:
    """A3: `tv` is `show`, rows without id go, ISO time to epoch, the last duplicate wins."""
    media = F.when(F.col("media_type") == "tv", "show").otherwise(F.col("media_type"))
    out = rows.where(F.col("tmdb_id").isNotNull()).select("tmdb_id", media.alias("media_type"), F.unix_timestamp(F.to_timestamp("added_at")).alias("added_at"), "status", "seq")
    return newest(out, KEY, F.col("seq")).drop("seq")


def load_requests(rows: DataFrame) -> DataFrame:
    """A4: nested request records flattened."""
    media = F.when(F.col("media.mediaType") == "tv", "show").otherwise(F.col("media.mediaType"))
    return rows.where(F.col("media.tmdbId").isNotNull()).select(
        F.col("id").alias("request_id"), F.col("requestedBy.plexId").alias("user_id"), F.col("media.tmdbId").alias("tmdb_id"), media.alias("media_type"), F.unix_timestamp(F.to_timestamp("createdAt")).alias("created_at")
    )


_IDS = "array<struct<id:bigint>>"
_NAMED = "array<struct<id:bigint,name:string>>"
DOCUMENT = f"""id bigint, title string, name string, release_date string, first_air_date string, genres {_NAMED},
 keywords struct<keywords:{_NAMED},results:{_NAMED}>, credits struct<cast:{_IDS},crew:array<struct<id:bigint,job:string>>>, created_by {_IDS},
 release_dates struct<results:array<struct<iso_3166_1:string,release_dates:array<struct<certification:string>>>>>,
 content_ratings struct<results:array<struct<iso_3166_1:string,rating:string>>>, original_language string, origin_country array<string>,
 production_countries array<struct<iso_3166_1:string>>, belongs_to_collection struct<id:bigint>, runtime int, episode_run_time array<int>,
 number_of_seasons int, vote_average double, vote_count bigint, popularity double, recommendations struct<results:{_IDS}>,
 similar struct<results:{_IDS}>, poster_path string, overview string"""
#: The jobs that count as makers of a film and of a show.
FILM_JOBS, SHOW_JOBS, HOME = ["Director"], ["Creator", "Executive Producer"], "US"


def _keywords(d: Column) -> Column:
    """Keywords stand under either of two names; an empty list counts as none."""
    first = d["keywords"]["keywords"]
    return F.when(F.size(first) > 0, first).otherwise(d["keywords"]["results"])


def parse_documents(rows: DataFrame, document: str = "document", media_type: str = "media_type") -> DataFrame:
    """Catalogue documents (JSON text, with their type) as items: release date by type and its year, lists of
    ids, ten of the cast, makers once each (directors; of shows the creators first, then creators and executive producers
    of the crew), home certification, the first episode's run time, countries, collection and listed titles. What a
    document lacks is null, a list is empty; text that is no JSON is an item without an id."""
    d = F.col("d")
    movie = F.col("media_type") == "movie"
    none, names = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    ids = lambda x: F.coalesce(F.transform(x, lambda y: y["id"]), none)
    jobs = lambda wanted: ids(F.filter(d["credits"]["crew"], lambda c: c["job"].isin(wanted)))
    last = lambda x: F.try_element_at(x, F.lit(-1))
    home = lambda x: last(F.filter(x, lambda e: e["iso_3166_1"] == HOME))
    releases = F.filter(home(d["release_dates"]["results"])["release_dates"], lambda r: r["certification"] != "")
    rated = F.when(movie, F.get(releases, F.lit(0))["certification"]).otherwise(F.nullif(home(d["content_ratings"]["results"])["rating"], F.lit("")))
    out = F.nullif(F.when(movie, d["release_date"]).otherwise(d["first_air_date"]), F.lit(""))
    countries = F.when(F.size(d["origin_country"]) > 0, d["origin_country"]).otherwise(F.coalesce(F.transform(d["production_countries"], lambda c: c["iso_3166_1"]), names))
    return rows.select(F.col(media_type).alias("media_type"), F.from_json(F.col(document), DOCUMENT).alias("d")).select(
        d["id"].alias("tmdb_id"),
        "media_type",
        F.coalesce(F.nullif(d["title"], F.lit("")), d["name"]).alias("title"),
        out.alias("release_date"),
        F.substring(out, 1, 4).try_cast("int").alias("year"),
        ids(d["genres"]).alias("genres"),
        ids(_keywords(d)).alias("keywords"),
        F.slice(ids(d["credits"]["cast"]), 1, 10).alias("cast"),
        F.array_distinct(F.when(movie, jobs(FILM_JOBS)).otherwise(F.concat(ids(d["created_by"]), jobs(SHOW_JOBS)))).alias("crew"),
        d["original_language"].alias("language"),
        countries.alias("countries"),
        rated.alias("certification"),
        d["belongs_to_collection"]["id"].alias("collection_id"),
        F.when(movie, d["runtime"]).otherwise(F.get(d["episode_run_time"], F.lit(0))).alias("runtime"),
        F.when(~movie, d["number_of_seasons"]).alias("seasons"),
        F.coalesce(d["vote_average"], F.lit(0.0)).alias("vote_average"),
        F.coalesce(d["vote_count"], F.lit(0)).alias("vote_count"),
        F.coalesce(d["popularity"], F.lit(0.0)).alias("popularity"),
        ids(d["recommendations"]["results"]).alias("recommendations"),
        ids(d["similar"]["results"]).alias("similar"),
        d["poster_path"].alias("poster_path"),
        d["overview"].alias("overview"),
    )


def keyword_names(rows: DataFrame, document: str = "document") -> DataFrame:
    """Id and name of every keyword that documents name; of several names the first in alphabetical order."""
    words = F.explode(_keywords(F.from_json(F.col(document), DOCUMENT))).alias("k")
    return rows.select(words).where("k.id is not null").groupBy(F.col("k.id").alias("keyword_id")).agg(F.min("k.name").alias("name"))


def read_ratings(spark: SparkSession, ratings_path: str, links_path: str) -> tuple[DataFrame, DataFrame]:
    """Rating and link files with declared schemas."""
    ratings = spark.read.csv(ratings_path, header=True, schema="userId bigint, movieId bigint, rating double, timestamp bigint")
    return ratings, spark.read.csv(links_path, header=True, schema="movieId bigint, imdbId string, tmdbId bigint")


def load_items(rows: DataFrame, lists: tuple[str, ...] = ("genres", "keywords", "cast", "crew", "recommendations", "similar")) -> DataFrame:
    """Stored items with their JSON lists decoded, absent figures as 0."""
    decoded = {c: F.coalesce(F.from_json(F.col(c), "array<bigint>"), F.array().cast("array<bigint>")) for c in lists if c in rows.columns}
    return rows.withColumns(decoded).na.fill(0, [c for c in ("vote_average", "vote_count", "popularity") if c in rows.columns])


def missing_from(wanted: DataFrame, stored: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Keys that are wanted and not stored."""
    return wanted.join(stored, keys, "left_anti")


def replace_table(df: DataFrame, path: str, *partitions: str) -> None:
    """A derived table, written whole."""
    df.write.partitionBy(*partitions).mode("overwrite").parquet(path)


def replace_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """The partitions that df has rows of are replaced, the others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).mode("overwrite").parquet(path)


def publish(df: DataFrame, root: str, built_at: int, *partitions: str) -> str:
    """A new build of a derived table. It is written beside the builds before it; only then a build record is appended,
    which makes it the current one. A write that breaks leaves no record, so readers keep the last whole build. A build
    is named by its time; to publish the same time again writes it anew."""
    build = f"build={built_at}"
    df.write.partitionBy(*partitions).mode("overwrite").parquet(f"{root}/{build}")
    record = df.sparkSession.range(1).select(F.lit(built_at).cast("long").alias("built_at"), F.lit(build).alias("build"))
    append_record(record, f"{root}/builds")
    return build


def published(spark: SparkSession, root: str) -> DataFrame:
    """The current build of a table."""
    last = spark.read.schema("built_at long, build string").parquet(f"{root}/builds").agg(F.max_by("build", "built_at")).first()[0]
    return spark.read.parquet(f"{root}/{last}")


def append_record(df: DataFrame, path: str) -> None:
    """One more build record."""
    df.write.mode("append").parquet(path)


def metadata(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(key, value) records by key: incoming ones replace stored ones."""
    return upsert(stored.select("key", "value"), incoming.select("key", "value"), ["key"])


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """A10: row counts by the given columns."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
