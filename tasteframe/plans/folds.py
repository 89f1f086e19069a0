"""All folds in one pass: a user of a fold is a walker of their own, so that scorers which know users only run once over
every fold's seeds, negatives and candidates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasteframe.functions import scalars as S
from tasteframe.functions.scalars import KEY
from tasteframe.operators import content, itemitem, pagerank
from tasteframe.operators.complement import Rankings

#: User ids are below this.
USERS = 1 << 40


def walkers(rows: DataFrame) -> DataFrame:
    """rows of (fold_id, user_id) with one id for both, in user_id."""
    return rows.withColumn("user_id", F.col("fold_id").cast("long") * USERS + F.col("user_id")).drop("fold_id")


def of_folds(rows: DataFrame) -> DataFrame:
    """rows of walkers with unit (the fold, as text) and user_id again."""
    return rows.withColumns({"unit": F.floor(F.col("user_id") / USERS).cast("string"), "user_id": F.col("user_id") % USERS})


def seeds(engaged: DataFrame, users: DataFrame, cuts: DataFrame) -> DataFrame:
    """Every fold's seeds of its users, with their weights at its cutoff: a range join with a few dozen folds."""
    rows = engaged.where("label = 'positive'").join(F.broadcast(cuts), F.col("first_at") <= F.col("cutoff")).join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi")
    return rows.select("fold_id", "user_id", *KEY, S.seed_weight(F.col("cutoff")).alias("weight"), "first_at", "last_at", "engagement", "tv_share")


def negatives(engaged: DataFrame, users: DataFrame, cuts: DataFrame) -> DataFrame:
    rows = engaged.where("label = 'weak_negative'").join(F.broadcast(cuts), F.col("last_at") <= F.col("cutoff"))
    return rows.join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi").select("fold_id", "user_id", *KEY)


def scores(own: DataFrame, dropped: DataFrame, cands: DataFrame, items: DataFrame, space: DataFrame, b: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Content (I6), graph (I7) and item-item (I9) scores of all folds' candidates: (unit, user_id, scorer, key, score).
    The catalogue's own work - similarities, graph, walks without restarts - is done once for all folds."""
    own, dropped, cands = cut(walkers(own)), walkers(dropped), cut(walkers(cands))
    made = {
        "content": content.seed_knn(space, own, dropped, cands, items),
        "graph": pagerank.personal_rank(items, own, cands, cut),
        "item_item": itemitem.fold_in(own, b, b.select(F.col("src").alias("tmdb_id")).distinct(), cands),
    }
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(n).alias("scorer"), "user_id", *KEY, "score") for n, df in made.items()))
    return of_folds(rows).select("unit", "user_id", "scorer", *KEY, "score")


def rankings(items: DataFrame, universe: DataFrame, engaged: DataFrame, requests: DataFrame, users: DataFrame, cuts: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> Rankings:
    """Votes and others' demand of every fold without its candidates: the fold's universe has one ranking each, its users
    their exceptions."""
    unit = F.col("fold_id").cast("string").alias("unit")
    seen = engaged.where("label = 'positive'").join(F.broadcast(cuts), F.col("first_at") <= F.col("cutoff")).select("fold_id", "user_id", *KEY)
    asked = requests.join(F.broadcast(cuts), F.col("created_at") <= F.col("cutoff")).select("fold_id", "user_id", *KEY).distinct()
    acts = cut(asked.unionByName(seen.distinct()))
    total = acts.groupBy("fold_id", *KEY).agg(F.count(F.lit(1)).alias("total"))
    titles = cut(universe.join(items.select(*KEY, "vote_count"), KEY).join(total, ["fold_id", *KEY], "left").na.fill(0, ["total"]))
    votes = titles.select(unit, F.lit("votes").alias("scorer"), *KEY, F.col("vote_count").cast("double").alias("score"))
    others = titles.select(unit, F.lit("others").alias("scorer"), *KEY, (F.col("total") * 1e9 + F.col("vote_count")).alias("score"))
    mine = acts.join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi").groupBy("fold_id", "user_id", *KEY).agg(F.count(F.lit(1)).alias("mine"))
    less = mine.join(titles, ["fold_id", *KEY]).select(unit, "user_id", F.lit("others").alias("scorer"), *KEY, ((F.col("total") - F.col("mine")) * 1e9 + F.col("vote_count")).alias("score"))
    own = seen.join(users.select("fold_id", "user_id"), ["fold_id", "user_id"], "left_semi").select(unit, "user_id", *KEY)
    return Rankings(users.select(unit, "user_id"), cut(votes.unionByName(others)), cut(own.distinct()), cut(less), cut)
