"""Rankings of all candidates of all users that are never made: one ranking of the universe, and each user's exceptions.

A scorer gives every title of the universe a score of its own (base; null: unscored), and some users some titles another
one (explicit). A user's candidates are the universe without their own titles. So the first of a list are the first of
the base ranking that are no exceptions, merged with the explicit rows; and a title's place is its place in the base
ranking, less the exceptions before it, plus the explicit rows before it. Work grows with the universe, with the users'
own rows, and with what is asked for: not with users times universe.

Order is by score, unscored last, then by key: that of evaluate.lists.

Where all candidates are the result, `remaining` makes them as a stream: nothing of users times universe is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasteframe.functions.scalars import KEY

UNIT = ["unit", "user_id"]


def order() -> list:
    return [F.col("score").desc_nulls_last(), F.col("media_type"), F.col("tmdb_id")]


def numbered(titles: DataFrame, by: str | None, order: list, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """titles with group_ (the column by, or nothing) and r, their number from 1 in the order within the group. Ranges are
    numbered each for itself, and start from the totals of those before."""
    titles = titles.withColumn("group_", F.col(by) if by else F.lit(""))
    ranged = cut(titles.repartitionByRange("group_", *order).withColumn("range_", F.spark_partition_id()))
    earlier = Window.partitionBy("group_").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("group_", "range_").agg(F.count(F.lit(1)).alias("rows_")).select("group_", "range_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)).alias("offset_"))
    rows = ranged.join(F.broadcast(totals), ["group_", "range_"])
    return rows.withColumn("r", (F.col("offset_") + F.row_number().over(Window.partitionBy("group_", "range_").orderBy(*order))).cast("int")).drop("range_", "offset_")


def remaining(
    users: DataFrame, titles: DataFrame, own: DataFrame, cut: Callable[[DataFrame], DataFrame], columns: tuple[str, ...] = (), order: list | None = None, by: str | None = None, first: int | None = None, after: int = 0,
    marks: DataFrame | None = None, size: int = 4096,
) -> DataFrame:
    """Every user's titles but their own, with the titles' columns, the columns of users, and of the group by (all titles
    without it) place, from 1 in the order, and n, how many there are; only places above `after` and up to `first`. marks
    (user_id, key, mark), a row a title at most, adds mark, null elsewhere.

    Titles stand in blocks of `size`, a user's own titles and marks are the numbers of a row of theirs. Users meet blocks,
    not titles, and a block is taken apart in the task that has met it: what is shuffled are the two sides.
    """
    order = order or [F.col(c) for c in KEY]
    ranks = cut(numbered(titles.select(*KEY, *(c for c in columns if c not in KEY)), by, order, cut))
    numbers = lambda rows, *more: rows.join(ranks.select(*KEY, "group_", "r"), KEY).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("group_", "r", *more))).alias("at"))
    people = users.join(numbers(own.select("user_id", *KEY).distinct()).withColumnRenamed("at", "gone_"), "user_id", "left")
    if marks is not None:
        people = people.join(numbers(marks, "mark").withColumnRenamed("at", "marks_"), "user_id", "left")
    extra = [c for c in columns if c not in KEY]
    blocks = ranks.groupBy("group_", F.expr(f"(r - 1) div {size}").alias("block_")).agg(F.sort_array(F.collect_list(F.struct("r", *KEY, *extra))).alias("titles_"))
    blocks = blocks.join(F.broadcast(ranks.groupBy("group_").agg(F.max("r").alias("whole_"))), "group_").withColumn("low_", (F.col("block_") * size).cast("int"))
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = people.repartition(tasks, "user_id").crossJoin(blocks)
    inside = lambda c: F.filter(c, lambda x: (x["group_"] == F.col("group_")) & (x["r"] > F.col("low_")) & (x["r"] <= F.col("low_") + size))
    met = met.withColumn("own_", F.coalesce(F.filter("gone_", lambda x: x["group_"] == F.col("group_")), F.array().cast("array<struct<group_:string,r:int>>")))
    met = met.withColumns({"start_": F.col("low_") - F.size(F.filter("own_", lambda x: x["r"] <= F.col("low_"))), "n": F.col("whole_") - F.size("own_"), "here_": F.transform(inside("own_"), lambda x: x["r"] - F.col("low_"))})
    if first is not None:
        met = met.where(F.col("start_") < first)
    starts, ends = F.concat(F.array(F.lit(0)), F.col("here_")), F.concat(F.transform("here_", lambda x: x - 1), F.array(F.size("titles_")))
    left = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("titles_", s + 1, e - s)))
    found = [F.map_from_entries(F.transform(inside("marks_"), lambda x: F.struct(x["r"], x["mark"]))).alias("found_")] if marks is not None else []
    met = met.select(*users.columns, "start_", "n", *found, F.posexplode(F.when(F.size("here_") > 0, left).otherwise(F.col("titles_"))).alias("i_", "t_"))
    mark = [F.try_element_at("found_", F.col("t_.r")).alias("mark")] if marks is not None else []
    rows = met.select(*users.columns, *(F.col(f"t_.{c}").alias(c) for c in (*KEY, *extra)), (F.col("start_") + F.col("i_") + 1).alias("place"), "n", *mark)
    rows = rows if first is None else rows.where(F.col("place") <= first)
    return rows.where(F.col("place") > after) if after else rows


@dataclass(frozen=True)
class Rankings:
    """users (unit, user_id); base (unit, scorer, key, score), every title of a unit's universe under every scorer; own
    (unit, user_id, key), what is no candidate; explicit (unit, user_id, scorer, key, score), which take the place of
    base rows. cut() writes a table and reads it again."""

    users: DataFrame
    base: DataFrame
    own: DataFrame
    explicit: DataFrame
    cut: Callable[[DataFrame], DataFrame]

    def _group(self, by_type: bool) -> list[str]:
        return ["unit", "scorer", *(["media_type"] if by_type else [])]

    def _explicit(self) -> DataFrame:
        """Explicit rows of candidates."""
        known = self.explicit.join(self.base.select("unit", "scorer", *KEY), ["unit", "scorer", *KEY], "left_semi")
        return known.join(self.own, [*UNIT, *KEY], "left_anti").select(*UNIT, "scorer", *KEY, "score")

    def _gone(self) -> DataFrame:
        """Base rows that do not hold for a user: their own titles, and those with an explicit score."""
        own = self.own.select(*UNIT, *KEY).distinct().join(self.base, ["unit", *KEY])
        told = self._explicit().select(*UNIT, "scorer", *KEY).join(self.base, ["unit", "scorer", *KEY])
        return own.unionByName(told)

    def top(self, k: int, by_type: bool = False) -> DataFrame:
        """The first k candidates of every user and scorer (and type): place, score and whether it is scored."""
        group = self._group(by_type)
        numbered = self.cut(self.base.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order()))))  # a narrow row a title
        size = numbered.groupBy(*group).agg(F.max("r").alias("size"))
        gone = self._gone().join(numbered.select("unit", "scorer", *KEY, "r"), ["unit", "scorer", *KEY]).groupBy("user_id", *group).agg(F.collect_list("r").alias("gone"))
        asked = self.users.select(*UNIT).distinct().join(F.broadcast(size), "unit").join(gone, ["user_id", *group], "left")
        none = F.coalesce("gone", F.array().cast("array<int>"))
        reach = F.least(F.col("size"), F.size(none) + k)
        free = asked.select("user_id", *group, F.explode(F.slice(F.array_except(F.sequence(F.lit(1), reach), none), 1, k)).alias("r"))
        free = free.join(numbered, [*group, "r"]).select(*UNIT, "scorer", *KEY, "score")
        rows = free.unionByName(self._explicit())
        place = F.row_number().over(Window.partitionBy("user_id", *group).orderBy(*order()))
        return rows.withColumns({"place": place, "scored": F.col("score").isNotNull()}).where(F.col("place") <= k)

    def places(self, wanted: DataFrame, by_type: bool = False) -> DataFrame:
        """The rows of wanted (unit, user_id, key) that are candidates, under every scorer, with their places."""
        group = self._group(by_type)
        told = self._explicit().withColumn("told", F.lit(True)).withColumnRenamed("score", "own_score")
        rows = wanted.select(*UNIT, *KEY).distinct().join(self.own, [*UNIT, *KEY], "left_anti").join(self.base, ["unit", *KEY])
        rows = rows.join(told, [*UNIT, "scorer", *KEY], "left").withColumn("score", F.when(F.col("told"), F.col("own_score")).otherwise(F.col("score")))
        rows = self.cut(rows.select(*UNIT, "scorer", *KEY, "score"))
        before = self._base_before(rows, group)
        mark = lambda df, n: df.select(*UNIT, "scorer", *KEY, "score", F.lit(n).alias("mark"), F.lit(None).cast("long").alias("before"))
        marks = before.withColumn("mark", F.lit(0)).unionByName(mark(self._gone(), -1)).unionByName(mark(self._explicit(), 1))
        so_far = Window.partitionBy("user_id", *group).orderBy(*order(), F.col("before").isNull()).rowsBetween(Window.unboundedPreceding, -1)
        place = F.col("before") + F.coalesce(F.sum("mark").over(so_far), F.lit(0)) + 1
        out = marks.withColumn("place", place.cast("int")).where(F.col("before").isNotNull())
        return out.select(*UNIT, "scorer", *KEY, "score", "place", F.col("score").isNotNull().alias("scored"))

    def _base_before(self, rows: DataFrame, group: list[str]) -> DataFrame:
        """rows with the number of base rows before each. Base and rows are sorted together in ranges; a row counts within
        its range, and the ranges before it by their totals."""
        base = self.base.select("unit", F.lit(None).cast("long").alias("user_id"), "scorer", *KEY, "score", F.lit(1).alias("is_base"))
        both = rows.withColumn("is_base", F.lit(0)).unionByName(base)
        by = [*group, *order(), "is_base"]
        ranged = self.cut(both.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
        totals = ranged.groupBy(*group, "range").agg(F.sum("is_base").alias("n"))
        earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*group, "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
        inside = Window.partitionBy(*group, "range").orderBy(*order(), "is_base").rowsBetween(Window.unboundedPreceding, -1)
        counted = ranged.withColumn("inside", F.coalesce(F.sum("is_base").over(inside), F.lit(0))).where("is_base = 0").join(totals, [*group, "range"])
        return counted.select(*UNIT, "scorer", *KEY, "score", (F.col("offset") + F.col("inside")).alias("before"))

    def scored(self) -> DataFrame:
        """How many candidates each scorer scores, per user."""
        one = lambda c: F.sum(F.when(c, 1).otherwise(0))
        some = F.col("score").isNotNull()
        all_ = self.base.groupBy("unit", "scorer").agg(one(some).alias("n"))
        change = self._gone().select(*UNIT, "scorer", F.when(some, -1).otherwise(0).alias("d")).unionByName(self._explicit().select(*UNIT, "scorer", F.when(some, 1).otherwise(0).alias("d")))
        change = change.groupBy(*UNIT, "scorer").agg(F.sum("d").alias("d"))
        rows = self.users.select(*UNIT).distinct().join(F.broadcast(all_), "unit").join(change, [*UNIT, "scorer"], "left")
        return rows.select(*UNIT, "scorer", (F.col("n") + F.coalesce("d", F.lit(0))).alias("scored"))
