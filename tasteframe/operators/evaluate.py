"""Measures of ranked lists: (unit, user_id, scorer, key, place) against positives (unit, user_id, key)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasteframe.functions.scalars import KEY

UNIT = ["unit", "user_id"]


def lists(scores: DataFrame, cands: DataFrame, by_type: bool = False) -> DataFrame:
    """Complete rankings of the candidates per scorer: by score, unscored ones last, ties by key; `scored` tells."""
    names = scores.select("unit", "scorer").distinct()
    rows = cands.join(F.broadcast(names), "unit").join(scores, [*UNIT, "scorer", *KEY], "left")
    group = [*UNIT, "scorer", *(["media_type"] if by_type else [])]
    order = Window.partitionBy(*group).orderBy(F.col("score").desc_nulls_last(), "media_type", "tmdb_id")
    return rows.select(*UNIT, "scorer", *KEY, F.row_number().over(order).alias("place"), F.col("score").isNotNull().alias("scored"))


def ideal(n, k: int):
    return F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def ndcg(ranked: DataFrame, positives: DataFrame, k: int = 50, by: list[str] | None = None) -> DataFrame:
    """Per group; the ideal is over the positives that are candidates; groups without any have no row."""
    by = [*UNIT, "scorer", *(by or [])]
    hits = ranked.join(positives, [*UNIT, *KEY], "left_semi")
    gain = F.sum(F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1.0)).otherwise(0.0))
    return hits.groupBy(*by).agg((gain / ideal(F.count(F.lit(1)), k)).alias("ndcg"))


def recall(ranked: DataFrame, positives: DataFrame, ks: tuple[int, ...] = (10, 20, 50, 100), by: list[str] | None = None) -> DataFrame:
    """J2."""
    hits = ranked.join(positives, [*UNIT, *KEY], "left_semi")
    return hits.groupBy(*UNIT, "scorer", *(by or [])).agg(*(F.avg((F.col("place") <= k).cast("double")).alias(f"recall_{k}") for k in ks))


def coverage(hits: DataFrame, scored: DataFrame, positives: DataFrame) -> DataFrame:
    """Share of the positives that are candidates, share of those that are scored, and the number of scored titles
    (scored, per unit, user and scorer). hits are the ranked positives."""
    n = positives.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("positives"))
    found = hits.join(positives, [*UNIT, *KEY], "left_semi").groupBy(*UNIT, "scorer").agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("scored")).alias("found"))
    out = scored.join(n, UNIT).join(found, [*UNIT, "scorer"], "left").na.fill(0, ["hits", "found"])
    return out.select(*UNIT, "scorer", "positives", "scored", (F.col("hits") / F.col("positives")).alias("coverage"), (F.col("found") / F.nullif("hits", F.lit(0))).alias("pool_recall"))


def diagnostics(ranked: DataFrame, items: DataFrame, own: DataFrame, k: int = 50) -> DataFrame:
    """Of the first k titles the upper median year, the share of movies, and the Jensen-Shannon divergence
    of their decades from those of the user's seeds."""
    group = [*UNIT, "scorer"]
    top = ranked.where(F.col("place") <= k).join(items.select(*KEY, "year"), KEY)
    years = F.sort_array(F.collect_list(F.when(F.col("year") != 0, F.col("year"))))  # at most k a group
    shape = top.groupBy(*group).agg(years.alias("years"), F.avg((F.col("media_type") == "movie").cast("double")).alias("movie_share"))
    shape = shape.select(*group, F.get("years", F.floor(F.size("years") / 2).cast("int")).alias("median_year"), "movie_share")
    decade = F.expr("year div 10 * 10").alias("decade")
    mine = top.where("year != 0").groupBy(*group, decade).agg(F.count(F.lit(1)).alias("a"), F.lit(0).cast("long").alias("b"))
    seeds = own.join(items.where("year != 0").select(*KEY, "year"), KEY).groupBy(*UNIT, decade).agg(F.count(F.lit(1)).alias("b"))
    seeds = seeds.join(shape.select(*group), UNIT).select(*group, "decade", F.lit(0).cast("long").alias("a"), "b")
    both = mine.unionByName(seeds).groupBy(*group, "decade").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    whole = Window.partitionBy(*group)
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
    both = both.withColumns({"pa": share("a"), "pb": share("b")})
    term = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(2 * F.col(c) / (F.col("pa") + F.col("pb")))).otherwise(0.0)
    js = both.groupBy(*group).agg((0.5 * F.sum(term("pa") + term("pb"))).alias("decade_js"))
    return shape.join(js, group, "left")


def collapsed(ranked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Equal lists once: (unit, scorer, list, key, place) of the distinct first-k lists, and (unit, user_id, scorer, list)
    of every user; a list is the digest of its titles in order. A user's k titles are what is collected."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("place", *KEY))), lambda x: F.concat_ws(":", x["media_type"], x["tmdb_id"].cast("string")))
    top = ranked.where(F.col("place") <= k).select(*UNIT, "scorer", *KEY, "place")
    members = top.groupBy(*UNIT, "scorer").agg(F.md5(F.array_join(names, " ").cast("binary")).alias("list"))
    one = members.groupBy("unit", "scorer", "list").agg(F.min("user_id").alias("user_id"))
    return one.join(top, [*UNIT, "scorer"]).drop("user_id"), members


def personalisation(ranked: DataFrame, positives: DataFrame, own: DataFrame, k: int = 50) -> DataFrame:
    """A user's own list on their positives against the mean of the other users' lists on them; positives are
    candidates, own (unit, user_id, key) are the titles that are none. A user without a hit counts 0.

    A hit's place is that among the list's titles which are candidates of the positives' user: its place less the user's
    own titles before it. Equal lists are met once, for as many users as have them.
    """
    entries, members = collapsed(ranked, k)
    n = positives.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
    hits = positives.select(*UNIT, *KEY).distinct().join(entries, ["unit", *KEY]).select(*UNIT, "scorer", "list", "place", F.lit(True).alias("hit"))
    met = hits.select(*UNIT, "scorer", "list").distinct()
    owned = own.select(*UNIT, *KEY).distinct().join(entries, ["unit", *KEY]).join(met, [*UNIT, "scorer", "list"], "left_semi")
    marks = hits.unionByName(owned.select(*UNIT, "scorer", "list", "place", F.lit(False).alias("hit")))
    before = Window.partitionBy(*UNIT, "scorer", "list").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    gain = 1 / F.log2(F.col("place") - F.coalesce(F.sum((~F.col("hit")).cast("int")).over(before), F.lit(0)) + 1.0)
    each = marks.withColumn("gain", gain).where("hit").groupBy(*UNIT, "scorer", "list").agg(F.sum("gain").alias("gain")).join(n, UNIT)
    each = each.select(*UNIT, "scorer", "list", (F.col("gain") / ideal(F.col("n"), k)).alias("v"))
    listers = members.groupBy("unit", "scorer", "list").agg(F.count(F.lit(1)).alias("listers"))
    users = members.groupBy("unit", "scorer").agg(F.count(F.lit(1)).alias("users"))
    all_ = each.join(listers, ["unit", "scorer", "list"]).groupBy(*UNIT, "scorer").agg(F.sum(F.col("v") * F.col("listers")).alias("all_lists"))
    mine = each.join(members, [*UNIT, "scorer", "list"]).select(*UNIT, "scorer", F.col("v").alias("mine"))
    out = n.join(users, "unit").join(all_, [*UNIT, "scorer"], "left").join(mine, [*UNIT, "scorer"], "left").na.fill(0.0, ["all_lists", "mine"])
    return out.select(*UNIT, "scorer", F.col("mine").alias("own_ndcg"), F.when(F.col("users") > 1, (F.col("all_lists") - F.col("mine")) / (F.col("users") - 1)).alias("others_ndcg"))


def overlap(ranked: DataFrame, k: int = 50) -> DataFrame:
    """Mean Jaccard similarity of a user's first k with every other user's; 0 where no title is shared. Equal lists
    are met once, for as many users as have them; pairs of lists without a common title are never made."""
    entries, members = collapsed(ranked, k)
    on = ["unit", "scorer", "list"]
    lists_ = entries.groupBy(*on).agg(F.count(F.lit(1)).alias("size")).join(members.groupBy(*on).agg(F.count(F.lit(1)).alias("listers")), on)
    one, two = entries.select(*on, *KEY), entries.select("unit", "scorer", F.col("list").alias("other"), *KEY)
    shared = one.join(two, ["unit", "scorer", *KEY]).where("list != other").groupBy(*on, "other").agg(F.count(F.lit(1)).alias("both"))
    others = lists_.select("unit", "scorer", F.col("list").alias("other"), F.col("size").alias("other_size"), F.col("listers").alias("others"))
    rows = shared.join(lists_, on).join(others, ["unit", "scorer", "other"])
    sums = rows.groupBy(*on).agg(F.sum(F.col("others") * F.col("both") / (F.col("size") + F.col("other_size") - F.col("both"))).alias("total"))
    users = members.groupBy("unit", "scorer").agg(F.count(F.lit(1)).alias("users"))
    out = members.join(lists_, on).join(users, ["unit", "scorer"]).join(sums, on, "left")
    mean = (F.coalesce("total", F.lit(0.0)) + F.col("listers") - 1) / (F.col("users") - 1)  # equal lists have similarity 1
    return out.select(*UNIT, "scorer", F.when(F.col("users") > 1, mean).alias("jaccard"))


def _differences(rows: DataFrame, metric: str, reference: str, by: list[str]) -> DataFrame:
    """Per group, scorer and user: the sum of differences to the reference on the same unit, and their number."""
    own = rows.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    base = own.where(F.col("scorer") == reference).select(*by, *UNIT, F.col(metric).alias("base"))
    return own.join(base, [*by, *UNIT]).groupBy(*by, "scorer", "user_id").agg(F.sum(F.col(metric) - F.col("base")).alias("total"), F.count(F.lit(1)).alias("n"))


def paired(rows: DataFrame, metric: str, reference: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean difference to the reference scorer on the same unit and user, and the users it wins and loses, for every
    group of the columns by."""
    users = _differences(rows, metric, reference, list(by))
    mean = F.col("total") / F.col("n")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return users.groupBy(*by, "scorer").agg((F.sum("total") / F.sum("n")).alias("delta"), one(mean > 1e-9).alias("wins"), one(mean < -1e-9).alias("losses"), F.count(F.lit(1)).alias("users"))


#: Sums of the probabilities of 0, 1, 2, ... draws of a user, whose expected number is one.
DRAWS = tuple(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]).tolist())


def bootstrap(rows: DataFrame, metric: str, reference: str, samples: int = 2000, by: tuple[str, ...] = ()) -> DataFrame:
    """95 % interval of the mean difference to the reference over resampled users, for every group of the columns by.
    A user is a sum and a count, drawn a Poisson number of times in each sample (the limit of drawing with replacement),
    which a hash of user and sample sets; so samples are sums, added up within tasks, and no task holds all users."""
    drawn = _differences(rows, metric, reference, list(by)).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    digits = F.substring(F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("sample").cast("string")).cast("binary")), 1, 8)
    chance = F.conv(digits, 16, 10).cast("double") / float(1 << 32)
    times = sum(((chance >= edge).cast("int") for edge in DRAWS), F.lit(0))
    sums = drawn.withColumn("times", times).groupBy(*by, "scorer", "sample").agg(F.sum(F.col("times") * F.col("total")).alias("total"), F.sum(F.col("times") * F.col("n")).alias("n"))
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return sums.groupBy(*by, "scorer").agg(F.percentile(mean, F.lit(0.025)).alias("low"), F.percentile(mean, F.lit(0.975)).alias("high"))


def summarise(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric per scorer, without NaN, and the number of units."""
    return rows.groupBy("scorer").agg(*(F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in metrics), F.count(F.lit(1)).alias("units"))


def report(rows: DataFrame, metrics: list[str], references: tuple[str, ...], samples: int = 2000) -> DataFrame:
    """The tables of a report in one: per subset, metric, reference and scorer the mean, the number of units, the paired
    difference with wins, losses and users, and its interval. rows (unit, user_id, scorer, part, metrics); the subsets are
    "all" and each part, by grouping sets for the means; a metric that is null or NaN does not count."""
    long = rows.select("part", *UNIT, "scorer", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("e")).select("part", *UNIT, "scorer", "e.*")
    good = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sets = [["part", "metric", "scorer"], ["metric", "scorer"]]
    means = good.groupingSets(sets, "part", "metric", "scorer").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("units"), F.grouping("part").alias("whole"))
    means = means.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("part")).alias("subset"), "metric", "scorer", "mean", "units")
    each = good.withColumn("subset", F.explode(F.array(F.lit("all"), F.col("part"))))
    by = ("subset", "metric")
    against = (paired(each, "value", r, by).join(bootstrap(each, "value", r, samples, by), [*by, "scorer"]).withColumn("reference", F.lit(r)) for r in references)
    return reduce(DataFrame.unionByName, against).join(means, [*by, "scorer"])
