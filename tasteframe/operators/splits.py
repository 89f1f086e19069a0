"""Evaluation splits: folds over time, and a holdout of each user's newest titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasteframe.functions.scalars import DAY, KEY


def folds(spark: SparkSession, first: str, now: int, window_days: int = 180) -> DataFrame:
    """H8: quarterly cutoffs with a window each, as long as the window ends by `now`. A few dozen rows."""
    days = spark.sql(f"SELECT explode(sequence(date '{first}', date(timestamp_seconds({now})), interval 3 months)) AS day")
    out = days.select(F.unix_timestamp(F.to_timestamp("day")).alias("cutoff")).withColumn("window_end", F.col("cutoff") + window_days * DAY).where(F.col("window_end") <= now)
    return out.withColumn("fold_id", (F.row_number().over(Window.orderBy("cutoff")) - 1).cast("int"))


def fold_users(engaged: DataFrame, evaluated: DataFrame, cuts: DataFrame, least: int = 10) -> DataFrame:
    """C4: evaluated users with enough positives by a cutoff. Folds are few, so they are broadcast."""
    rows = engaged.where("label = 'positive'").join(evaluated.where("evaluated").select("user_id"), "user_id", "left_semi")
    rows = rows.join(F.broadcast(cuts), F.col("first_at") <= F.col("cutoff"))
    return rows.groupBy("fold_id", "user_id").agg(F.count(F.lit(1)).alias("train_positives")).where(F.col("train_positives") >= least)


def fold_positives(engaged: DataFrame, library: DataFrame, requests: DataFrame, users: DataFrame, cuts: DataFrame) -> DataFrame:
    """What a user first watched in the window after it was added in the window; and what they requested in it
    that the library did not have by the cutoff. Windows are open at the cutoff, closed at the end; watched wins."""
    within = lambda c: (F.col(c) > F.col("cutoff")) & (F.col(c) <= F.col("window_end"))
    cuts = F.broadcast(cuts)
    watched = engaged.where("label = 'positive'").join(library.select(*KEY, "added_at"), KEY).join(cuts, within("added_at") & within("first_at"))
    watched = watched.join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi").select("fold_id", "user_id", *KEY, F.lit(0).alias("rank"), F.lit("watched").alias("kind"))
    asked = requests.join(library.select(*KEY, "added_at"), KEY, "left").join(cuts, within("created_at") & (F.col("added_at").isNull() | (F.col("added_at") > F.col("cutoff"))))
    asked = asked.join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi").select("fold_id", "user_id", *KEY, F.lit(1).alias("rank"), F.lit("requested").alias("kind"))
    return watched.union(asked).groupBy("fold_id", "user_id", *KEY).agg(F.min_by("kind", "rank").alias("kind"))


def holdout(engaged: DataFrame, evaluated: DataFrame, most: int = 30, share: float = 0.2) -> DataFrame:
    """Of each user's positives of a type, the newest fifth, thirty at most; ties to the smaller id."""
    group = Window.partitionBy("user_id", "media_type")
    rows = engaged.where("label = 'positive'").join(evaluated.where("evaluated").select("user_id"), "user_id", "left_semi")
    rows = rows.withColumns({"place": F.row_number().over(group.orderBy(F.desc("first_at"), "tmdb_id")), "total": F.count(F.lit(1)).over(group)})
    return rows.where(F.col("place") <= F.least(F.lit(most), F.floor(share * F.col("total")))).select("user_id", *KEY)


def fold_report(positives: DataFrame) -> DataFrame:
    """Positives by fold and user, a column a kind."""
    out = positives.groupBy("fold_id", "user_id").pivot("kind", ["watched", "requested"]).agg(F.count(F.lit(1)))
    return out.na.fill(0, ["watched", "requested"])
