"""What a user is ranked from: seeds, negatives, candidates, and what the others did - as tables, never as objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasteframe.functions import scalars as S
from tasteframe.functions.scalars import KEY
from tasteframe.operators.complement import remaining


def catalogue(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items with enough votes since 1950 are in the catalogue; those known from history, library or requests
    stay with flag 0, which votes raise."""
    votes = F.when(F.col("media_type") == "movie", F.col("vote_count") >= 100).otherwise(F.col("vote_count") >= 50)
    found = items.where(votes & (F.col("year") >= 1950)).select(*KEY, F.lit(1).alias("in_catalogue"))
    kept = known.select(*KEY).distinct().join(items.select(*KEY), KEY, "left_semi").withColumn("in_catalogue", F.lit(0))
    return found.unionByName(kept).groupBy(*KEY).agg(F.max("in_catalogue").alias("in_catalogue"))


def fold_universe(items: DataFrame, library: DataFrame, requests: DataFrame, cuts: DataFrame) -> DataFrame:
    """Per fold, catalogue titles released by the window's end that nobody had or had asked for by the cutoff."""
    cuts = F.broadcast(cuts)
    end = F.date_format(F.timestamp_seconds("window_end"), "yyyy-MM-dd")
    out = items.where("in_catalogue and release_date is not null").select(*KEY, "release_date").crossJoin(cuts).where(F.col("release_date") <= end)
    had = library.join(cuts, F.col("added_at").isNull() | (F.col("added_at") <= F.col("cutoff"))).select("fold_id", *KEY)
    asked = requests.join(cuts, F.col("created_at") <= F.col("cutoff")).select("fold_id", *KEY)
    on = ["fold_id", *KEY]
    return out.join(had, on, "left_anti").join(asked, on, "left_anti").select(*on)


def universe(items: DataFrame, library: DataFrame, requests: DataFrame, surface: str, now: int, lag_days: int = 45) -> DataFrame:
    """Production candidates: `library`, or `missing`: the catalogue without library and requests, movies out for
    some weeks, shows by today."""
    if surface == "library":
        return items.select(*KEY).join(library, KEY, "left_semi")
    today = F.to_date(F.timestamp_seconds(F.lit(now)))
    out = F.when(F.col("media_type") == "movie", F.date_sub(today, lag_days)).otherwise(today)
    found = items.where(F.col("in_catalogue") & (F.col("release_date") <= out.cast("string")))
    return found.select(*KEY).join(library, KEY, "left_anti").join(requests, KEY, "left_anti")


def holdout_universe(items: DataFrame, library: DataFrame, library_only: bool = False) -> DataFrame:
    """Candidates of the holdout: the catalogue, whatever is in the library; or the library's titles alone."""
    if library_only:
        return items.select(*KEY).join(library, KEY, "left_semi")
    return items.where("in_catalogue").select(*KEY)


def seeds(engaged: DataFrame, cutoff: Column, held_out: DataFrame | None = None) -> DataFrame:
    """A user's positives by the cutoff with their weights, without what is held out."""
    rows = engaged.where((F.col("label") == "positive") & (F.col("first_at") <= cutoff))
    rows = rows if held_out is None else rows.join(held_out, ["user_id", *KEY], "left_anti")
    return rows.select("user_id", *KEY, S.seed_weight(cutoff).alias("weight"), "first_at", "last_at", "engagement", "tv_share")


def negatives(engaged: DataFrame, cutoff: Column) -> DataFrame:
    return engaged.where((F.col("label") == "weak_negative") & (F.col("last_at") <= cutoff)).select("user_id", *KEY)


def candidates(users: DataFrame, titles: DataFrame, own: DataFrame, cut: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] = ()) -> DataFrame:
    """Every user's candidates: the universe without their own seeds, with columns of the titles. The universe meets
    each user by design, in blocks: see complement.remaining."""
    return remaining(users.select("user_id").distinct(), titles, own, cut, columns).select("user_id", *KEY, *columns)


def others_demand(own: DataFrame, requests: DataFrame, cutoff: Column, cands: DataFrame) -> DataFrame:
    """How many other users asked for a title or watched it: all less one's own, no join of users with users.
    Requests without a user count as one more user."""
    asked = requests.where(F.col("created_at") <= cutoff).select("user_id", *KEY).distinct().withColumn("what", F.lit("asked"))
    seen = own.select("user_id", *KEY).distinct().withColumn("what", F.lit("seen"))
    acts = asked.unionByName(seen)
    total = acts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"))
    mine = acts.where(F.col("user_id").isNotNull()).groupBy("user_id", *KEY).agg(F.count(F.lit(1)).alias("mine"))
    out = cands.join(total, KEY, "left").join(mine, ["user_id", *KEY], "left")
    return out.select("user_id", *KEY, (F.coalesce("total", F.lit(0)) - F.coalesce("mine", F.lit(0))).alias("demand"))


def demand_totals(own: DataFrame, requests: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """C6, D12 without the candidates: (key, total), and what a user's own acts take off it: (user_id, key, demand)."""
    asked = requests.where(F.col("created_at") <= cutoff).select("user_id", *KEY).distinct()
    acts = asked.unionAll(own.select("user_id", *KEY).distinct())
    total = acts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"))
    mine = acts.where(F.col("user_id").isNotNull()).groupBy("user_id", *KEY).agg(F.count(F.lit(1)).alias("mine"))
    return total, mine.join(total, KEY).select("user_id", *KEY, (F.col("total") - F.col("mine")).alias("demand"))


def fold_candidates(users: DataFrame, titles: DataFrame, engaged: DataFrame, cuts: DataFrame) -> DataFrame:
    """C5 for folds: (fold_id, user_id, key): each fold's universe for its users, without what they had watched by then."""
    seen = _by_cutoff(engaged.where("label = 'positive'"), "first_at", cuts)
    return users.select("fold_id", "user_id").join(titles.select("fold_id", *KEY), "fold_id").join(seen, ["fold_id", "user_id", *KEY], "left_anti")


def fold_demand(engaged: DataFrame, requests: DataFrame, cuts: DataFrame, cands: DataFrame) -> DataFrame:
    """C6 for folds: what others had asked for or watched by each fold's cutoff, for the candidates of fold_candidates."""
    asked = _by_cutoff(requests, "created_at", cuts).distinct().withColumn("what", F.lit("asked"))
    acts = asked.unionByName(_by_cutoff(engaged.where("label = 'positive'"), "first_at", cuts).distinct().withColumn("what", F.lit("seen")))
    total = acts.groupBy("fold_id", *KEY).agg(F.count(F.lit(1)).alias("total"))
    mine = acts.where(F.col("user_id").isNotNull()).groupBy("fold_id", "user_id", *KEY).agg(F.count(F.lit(1)).alias("mine"))
    out = cands.join(total, ["fold_id", *KEY], "left").join(mine, ["fold_id", "user_id", *KEY], "left")
    return out.select("fold_id", "user_id", *KEY, (F.coalesce("total", F.lit(0)) - F.coalesce("mine", F.lit(0))).alias("demand"))


def _by_cutoff(rows: DataFrame, at: str, cuts: DataFrame) -> DataFrame:
    """Rows of every fold by whose cutoff they had happened. Folds are a few dozen rows."""
    return rows.join(F.broadcast(cuts), F.col(at) <= F.col("cutoff")).select("fold_id", "user_id", *KEY)


def intent_seeds(own: DataFrame, requests: DataFrame, items: DataFrame, cutoff: Column, weight: float = 1.0) -> DataFrame:
    """one's own requests by the cutoff as seeds, unless they are seeds already or unknown."""
    asked = requests.where(F.col("user_id").isNotNull() & (F.col("created_at") <= cutoff)).groupBy("user_id", *KEY).agg(F.min("created_at").alias("at"))
    new = asked.join(own, ["user_id", *KEY], "left_anti").join(items, KEY, "left_semi")
    extra = new.select("user_id", *KEY, F.lit(weight).alias("weight"), F.col("at").alias("first_at"), F.col("at").alias("last_at"), F.lit(1.0).alias("engagement"), F.lit(None).cast("double").alias("tv_share"))
    return own.unionByName(extra)


def pooled_requests(requests: DataFrame, alias: DataFrame) -> DataFrame:
    """Requests under the canonical account, the earliest of each title."""
    from tasteframe.operators.engagement import canonical_user

    rows = canonical_user(requests.where(F.col("user_id").isNotNull()), alias)
    return rows.groupBy("user_id", *KEY).agg(F.min("created_at").alias("created_at"))


def family_seeds(own: DataFrame, items: DataFrame, threshold: float = 0.5, keep: float = 0.1) -> DataFrame:
    """children's titles that were watched on a shared screen weigh less."""
    rows = own.join(items.select(*KEY, S.is_kids().alias("kids")), KEY, "left")
    less = F.coalesce(F.col("kids") & (F.col("tv_share") >= threshold), F.lit(False))
    return rows.withColumn("weight", F.when(less, F.col("weight") * keep).otherwise(F.col("weight"))).drop("kids")


def family_candidates(users: DataFrame, titles: DataFrame, own: DataFrame, items: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Candidates without children's titles, which go before users meet the universe."""
    kids = items.where(S.is_kids()).select(*KEY)
    return candidates(users, titles.join(kids, KEY, "left_anti"), own, cut)


def heaviest(own: DataFrame, n: int | None) -> DataFrame:
    """the n heaviest seeds of every user, ties to the smaller key; all without n."""
    if not n:
        return own
    order = Window.partitionBy("user_id").orderBy(F.desc("weight"), "media_type", "tmdb_id")
    return own.withColumn("place_", F.row_number().over(order)).where(F.col("place_") <= n).drop("place_")


def unknown_ids(alias: DataFrame, users: DataFrame) -> DataFrame:
    """Accounts of the map that no user has."""
    named = alias.select(F.col("member").alias("user_id")).union(alias.select(F.col("canonical"))).distinct()
    return named.join(users, "user_id", "left_anti")
