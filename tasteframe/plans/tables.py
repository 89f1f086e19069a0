"""The tables that queries share, each built when it is first asked for."""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.functions.scalars import KEY
from tasteframe.operators import baselines, contexts, engagement, features, splits
from tasteframe.operators.complement import Rankings
from tasteframe.plans.views import FIRST_CUTOFF, NOW, view

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver next collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is set, a temporary one for a local master,
    as in tests; on a cluster executors could not see it, so it is refused there."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='tasteframe-')}"
        context.setCheckpointDir(named)
    return named.rstrip("/")


class Tables:
    """Views of a test data folder and what follows from them, for the production unit at NOW."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("plays", "titles", "items", "library", "requests", "users", "alias", "ratings", "links", "vectors"):
            self.__dict__[name] = view(self.spark, self.sf_dir, name)
            return self.__dict__[name]
        raise AttributeError(name)

    def folder(self, name: str) -> str:
        """A new folder for tables, in the one that the session names."""
        return f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"

    @staticmethod
    def cut(df: DataFrame) -> DataFrame:
        """End a lineage: a table in the folder that the session names. The shuffles that made it go with the write, as
        nothing reads them again."""
        spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path)

    @cached_property
    def evaluated(self) -> DataFrame:
        return engagement.completed_per_user(self.plays, self.users)

    @cached_property
    def engaged(self) -> DataFrame:
        return engagement.engagements(self.plays, self.titles, self.alias, NOW)

    @cached_property
    def folds(self) -> DataFrame:
        return splits.folds(self.spark, FIRST_CUTOFF, NOW)

    @cached_property
    def fold_users(self) -> DataFrame:
        return splits.fold_users(self.engaged, self.evaluated, self.folds)

    @cached_property
    def fold_positives(self) -> DataFrame:
        return splits.fold_positives(self.engaged, self.library, self.requests, self.fold_users, self.folds)

    @cached_property
    def seeds(self) -> DataFrame:
        return self.cut(contexts.seeds(self.engaged, F.lit(NOW)))

    @cached_property
    def negatives(self) -> DataFrame:
        return contexts.negatives(self.engaged, F.lit(NOW))

    @cached_property
    def universe(self) -> DataFrame:
        return contexts.universe(self.items, self.library, self.requests, "missing", NOW)

    @cached_property
    def cands(self) -> DataFrame:
        return contexts.candidates(self.users, self.universe, self.seeds, self.cut)

    @cached_property
    def demand(self) -> DataFrame:
        return contexts.others_demand(self.seeds, self.requests, F.lit(NOW), self.cands)

    @cached_property
    def space(self) -> DataFrame:
        return features.tfidf(self.items)

    @cached_property
    def recent(self) -> DataFrame:
        return baselines.recent_seeds(self.seeds, F.lit(NOW))

    @cached_property
    def pools(self) -> DataFrame:
        return baselines.pool(self.recent, self.items, self.users, self.universe, self.seeds)

    @cached_property
    def pooled(self) -> DataFrame:
        """The pool's scores, the only ones that are not the same for all users but for their own acts."""
        return self.pools.select(F.lit("pool").alias("component"), "user_id", *KEY, (F.col("seeds") * 10.0 + F.col("best_seed") % 7).alias("score"))

    @cached_property
    def votes(self) -> DataFrame:
        """The universe by votes: key, score."""
        return self.universe.select(*KEY).join(self.items.select(*KEY, F.col("vote_count").cast("double").alias("score")), KEY)

    @cached_property
    def scores(self) -> DataFrame:
        """Three scorers' scores, as the evaluation takes them: unit, user, key, scorer, score."""
        one = lambda df, name: df.select(F.lit("now").alias("unit"), "user_id", *KEY, F.lit(name).alias("scorer"), F.col("score").cast("double").alias("score"))
        pool = self.pooled.withColumnRenamed("component", "scorer")
        return one(baselines.global_popularity(self.users, self.universe, self.seeds, self.items, self.cut), "votes").union(one(baselines.household_popularity(self.demand, self.items), "others")).union(one(pool, "pool"))

    @cached_property
    def rankings(self) -> Rankings:
        """The same scorers over the universe, with each user's exceptions: see complement.Rankings."""
        now = lambda df: df.withColumn("unit", F.lit("now"))
        total, less = contexts.demand_totals(self.seeds, self.requests, F.lit(NOW))
        titles = self.universe.select(*KEY).join(self.items.select(*KEY, F.col("vote_count").cast("double").alias("votes")), KEY).join(total, KEY, "left")
        base = lambda scorer, score: now(titles).select("unit", F.lit(scorer).alias("scorer"), *KEY, score.cast("double").alias("score"))
        wanted = F.coalesce("total", F.lit(0)) * 1e9 + F.col("votes")
        votes = self.items.select(*KEY, "vote_count")
        explicit = now(less.join(votes, KEY)).select("unit", "user_id", F.lit("others").alias("scorer"), *KEY, (F.col("demand") * 1e9 + F.col("vote_count")).alias("score"))
        pool = now(self.pools).select("unit", "user_id", F.lit("pool").alias("scorer"), *KEY, (F.col("seeds") * 10.0 + F.col("best_seed") % 7).alias("score"))
        bases = base("votes", F.col("votes")).union(base("others", wanted)).union(base("pool", F.lit(None)))
        own = now(self.seeds).select("unit", "user_id", *KEY)
        return Rankings(now(self.users.select("user_id")), self.cut(bases), self.cut(own), self.cut(explicit.unionByName(pool)), self.cut)
