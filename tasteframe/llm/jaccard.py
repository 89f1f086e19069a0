"""N-gram Jaccard join by grouped prefixes.

Documents are sets of word shingles. Equal sets are one class. With a global order of shingles, rare ones first, two
sets whose similarity reaches the threshold share a shingle in their prefixes. Classes with the same prefix and size
form a group; shingles join groups, sizes filter group pairs, and members are verified with their whole sets.

The order comes from a sketch of fixed size that counts all shingles; any order gives whole results, a good one few
candidates. Groups that share a shingle are not paired with one another at first: each is verified against one leader,
what links falls into one component, and only pairs of groups of different components are left. Those are taken whole,
so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, fresh, mixed, slices, table, text_bytes, tidy, written
from tasteframe.llm.components import components
from tasteframe.llm.substrings import in_bitmap, repeated_bitmap
from tasteframe.llm.windows import rolling, signed, word_hashes

#: Counters of the sketch (4 MB), and how many of them a row carries.
COUNTERS, PART = 1 << 20, 1 << 14


def shingles(text: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of the lower-cased text, as 64-bit hashes; fewer words are one shingle."""
    x = word_hashes(text.lower().split())
    if not len(x):
        return x
    return np.unique(mixed(rolling(x, min(n, len(x))) + np.uint64(min(n, len(x)))))


def counts_of_all(texts: DataFrame, n: int) -> np.ndarray:
    """The sketch: how many documents hold a shingle of each bucket. Summed in two steps, so that no task gathers one
    row from every other; the sums come to the driver in one job, however many partitions they are dealt over."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t, n) for t in part.column(0).to_pylist()]
                if found:
                    total += np.bincount((np.concatenate(found) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        where = TaskContext.get().partitionId() % 1000
        parts = [total[at : at + PART].astype(np.uint32).tobytes() for at in range(0, COUNTERS, PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts))), pa.array([where] * len(parts)), pa.array(parts, type=pa.binary())], names=["part", "some", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, dtype=np.uint32).astype(np.int64) for c in rows["counts"].to_pylist())
        return pa.table({"part": rows["part"][:1], "some": rows["some"][:1], "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], type=pa.binary())})

    schema = "part long, some long, counts binary"
    sums = texts.mapInArrow(tidy(count), schema).groupBy("part", "some").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    out = np.zeros(COUNTERS, dtype=np.uint32)
    parts = sums.toArrow()
    for k, counts in zip(parts["part"].to_pylist(), parts["counts"], strict=True):
        out[k * PART : (k + 1) * PART] = np.frombuffer(counts.as_buffer(), dtype=np.uint32)
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """Parity bits of a set, 512 at least and as many as it has members or up to twice that: two sets' signatures differ
    in no more bits than the sets in members."""
    size = max(512, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing_bits(x: Column, y: Column) -> Column:
    """In how many bits two signatures differ; the halves of the longer one are added up first, as long as it is longer."""
    odd = lambda a, b: a.bitwiseXOR(b)
    short = F.least(F.size(x), F.size(y))
    half = lambda c: F.when(F.size(c) > short, F.zip_with(F.slice(c, F.lit(1), short), F.slice(c, short + 1, short), odd)).otherwise(c)
    plain = sum((F.bit_count(odd(x[i], y[i])) for i in range(8)), F.lit(0))
    folded = F.aggregate(F.zip_with(half(x), half(y), lambda a, b: F.bit_count(odd(a, b))), F.lit(0), lambda total, n: total + n)
    return F.when((F.size(x) == 8) & (F.size(y) == 8), plain).when(F.size(x) <= 2 * short, F.when(F.size(y) <= 2 * short, folded))


def similar(n_a: Column, n_b: Column, shared: Column, percent: int) -> Column:
    return (100 + percent) * shared >= percent * (n_a + n_b)


class Join:
    """The steps of one join, over rows (key, text)."""

    def __init__(self, docs: DataFrame, n: int, percent: int, key: str, text: str):
        self.n, self.percent = n, percent
        self.texts = text_bytes(docs.select(F.col(key).alias("key"), F.hash(text).alias("version"), F.col(text).alias("text")), "key", "version")
        self.context = docs.sparkSession.sparkContext
        self.kind = docs.schema[key].dataType.simpleString()

    def describe(self) -> DataFrame:
        """A row a document: key, version (a hash of its text), n, id of its set; its group, prefix and signature, once a task for equal sets."""
        sketch = self.context.broadcast(counts_of_all(self.texts.select("text"), self.n))
        n_words, percent = self.n, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                for part in slices(batch, "text"):
                    sizes, ids, prefixes, groups, marks = [], [], [], [], []
                    for text in part.column(2).to_pylist():
                        own = shingles(text, n_words)
                        size = len(own)
                        sizes.append(size)
                        ids.append(xxhash.xxh3_128_digest(own.tobytes()) if size else None)
                        if not size or ids[-1] in seen:
                            prefixes.append(None)
                            groups.append(None)
                            marks.append(None)
                            continue
                        if len(seen) < 200_000:
                            seen.add(ids[-1])
                        rare = np.argsort(sketch.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)], kind="stable")
                        first = own[rare[: size + (-percent * size // 100) + 1]]
                        prefixes.append(signed(first))
                        marks.append(signature(own))
                        groups.append(xxhash.xxh3_128_digest(first.tobytes() + size.to_bytes(8, "little")))
                    columns = [part.column(0), part.column(1), pa.array(sizes, type=pa.int64()), pa.array(ids, type=pa.binary()), pa.array(groups, type=pa.binary()), *(pa.array(x, type=pa.list_(pa.int64())) for x in (prefixes, marks))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "version", "n", "id", "group", "prefix", "sig"])

        return self.texts.mapInArrow(tidy(run), f"key {self.kind}, version int, n long, id binary, group binary, prefix array<long>, sig array<long>")

    def tokens(self) -> DataFrame:
        """token, g, n, pos, many (the group holds several classes): the index of the shingles that stand in the prefixes
        of several groups, but for what a bitmap of fixed size lets pass besides."""
        bitmap = self.context.broadcast(repeated_bitmap(self.groups.select(F.explode("prefix").alias("h"), F.lit(1).alias("n"))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, token, place = [], [], []
                for i, prefix in enumerate(batch.column(3)):
                    h = prefix.values.to_numpy().view(np.uint64)
                    at = np.nonzero(in_bitmap(bitmap.value, h))[0]
                    of.append(np.full(len(at), i))
                    token.append(h[at])
                    place.append(at.astype(np.int32))
                if of:
                    rows = pa.array(np.concatenate(of))
                    columns = [pa.array(signed(np.concatenate(token))), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(place)), batch.column(2).take(rows)]
                    yield pa.RecordBatch.from_arrays(columns, names=["token", "g", "n", "pos", "many"])

        groups = self.groups.select("g", F.col("n").cast("int").alias("n"), F.col("sig").isNull().alias("many"), "prefix")
        return groups.mapInArrow(tidy(run), "token long, g long, n int, pos int, many boolean")

    def sets(self, ids: DataFrame) -> DataFrame:
        """id and whole set of the given classes: read from the texts again, of documents whose key a bitmap of fixed
        size lets pass."""
        keys = self.classes.join(ids, "id", "left_semi").select(F.xxhash64("key").alias("h"), F.lit(2).alias("n"))
        bitmap = self.context.broadcast(repeated_bitmap(keys))
        n_words = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    passed = part.filter(pa.array(in_bitmap(bitmap.value, part.column(0).to_numpy().view(np.uint64))))
                    sets = [shingles(t, n_words) for t in passed.column(1).to_pylist()]
                    names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                    yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.binary()), pa.array([signed(s) for s in sets], type=pa.list_(pa.int64()))], names=["id", "set"])

        texts = self.texts.select(F.xxhash64("key").alias("h"), "text")
        return texts.mapInArrow(tidy(run), "id binary, set array<long>").where("size(set) > 0").join(ids, "id", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the written pairs (a, b) of classes that link, by their whole sets."""
        sets = written(self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "wanted")
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        found = written(both.where(similar(F.size("set_a"), F.size("set_b"), shared, self.percent)).select("a", "b").distinct(), "found")
        discard(sets)
        return found

    def fit(self, x: str, y: str) -> Column:
        """The sizes are near, and what stands before and after a shared shingle in both orders is enough."""
        of = lambda c: (F.col(f"{c}{x}"), F.col(f"{c}{y}"))
        (n, m), (p, q) = of("n"), of("pos")
        return similar(n, m, F.least(p, q) + F.least(n - p, m - q), self.percent)

    def apart(self, x: str, y: str) -> Column:
        """The sets, if each group has one, differ at least in as many shingles as their signatures in bits."""
        bits = differing_bits(F.col(f"sig{x}"), F.col(f"sig{y}"))
        return F.coalesce((100 + self.percent) * bits > (100 - self.percent) * (F.col(f"n{x}") + F.col(f"n{y}")), F.lit(False))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """The documents (key, version, n, id of the class), and id and comp of the classes that link with others."""
        rows = written(self.describe(), "sets")
        known = rows.where("n > 0")
        self.classes = written(known.groupBy("id").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.xxhash64(F.max("group")).alias("g")), "classes")
        # two groups may share a number: so each is kept, and its members meet
        groups = known.where(F.col("prefix").isNotNull()).groupBy("group").agg(F.min("id").alias("head"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.when(F.min("id") == F.max("id"), F.first("sig")).alias("sig"))
        self.groups = written(groups.select(F.xxhash64("group").alias("g"), "head", "n", "prefix", "sig"), "groups")
        docs = written(rows.select("key", "version", "n", "id"), "documents")
        discard(rows)
        index = written(self.tokens(), "index")
        heads = written(self.groups.select("g", "head", "n", "sig"), "heads")
        discard(self.groups)
        members = self.classes.select("g", "id")
        first = index.groupBy("token").agg(F.min(F.struct("pos", "n", "g")).alias("leader"), F.count(F.lit(1)).alias("groups"), F.max("many").alias("many")).where("groups > 1")
        leaders = written(first.select("token", F.col("leader.g").alias("leader"), F.col("leader.n").alias("n_leader"), F.col("leader.pos").alias("pos_leader"), ((F.col("groups") > 2) | F.col("many")).alias("more")), "leaders")
        pairs = index.join(leaders.drop("more"), "token").where((F.col("g") != F.col("leader")) & self.fit("", "_leader")).select("g", "leader").distinct()
        pairs = pairs.join(heads.drop("head"), "g").join(heads.toDF("leader", "head", "n_leader", "sig_leader"), "leader").where(~self.apart("", "_leader"))
        pairs = pairs.select("g", "head").union(heads.select("g", "head")).join(members, "g").where("id != head")
        tested = written(pairs.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")).distinct(), "pairs")
        links = self.verified(tested)
        comps = components(links)
        # each step is written: as one query, the driver would plan and describe all of it anew at each of its stages
        spans = written(self.of_groups(members, comps), "spans")
        left = written(self.still_open(index.join(leaders.where("more"), "token", "left_semi"), spans), "open")
        wide = left.join(heads.select("g", "sig"), "g").select("token", "g", "n", "pos", "sig", "low", "high")
        other = wide.toDF("token", "g2", "n2", "pos2", "sig2", "low2", "high2")
        settled = (F.col("low") == F.col("high2")) & (F.col("high") == F.col("low2"))
        met = wide.join(other, "token").where((F.col("g") < F.col("g2")) & self.fit("", "2") & ~self.apart("", "2") & ~settled)
        met = written(met.select("g", "g2").distinct(), "met")
        pairs = met.join(members, "g").withColumnRenamed("id", "x").join(members.toDF("g2", "y"), "g2")
        mixed_groups = members.join(spans.where("low != high").select("g"), "g", "left_semi")
        within = mixed_groups.join(mixed_groups.toDF("g", "y"), "g").where("id < y").select(F.col("id").alias("x"), "y")
        pairs = pairs.select("x", "y").union(within).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        pairs = written(self.between(pairs, comps).join(tested, ["a", "b"], "left_anti"), "pairs")
        discard(index, leaders, tested, heads, comps, spans, left, met)
        more = self.verified(pairs)
        discard(pairs)
        comps = components(links.union(more))
        discard(links, more)
        return docs, comps

    @staticmethod
    def between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose classes are in different components."""
        for side in ("a", "b"):
            pairs = pairs.join(comps.toDF(side, f"{side}_comp"), side, "left").withColumn(f"{side}_comp", F.coalesce(f"{side}_comp", side))
        return pairs.where("a_comp != b_comp").select("a", "b").distinct()

    @staticmethod
    def of_groups(members: DataFrame, comps: DataFrame) -> DataFrame:
        """The least and the greatest component of each group's members."""
        of = members.join(comps, "id", "left").select("g", F.coalesce("comp", "id").alias("comp"))
        return of.groupBy("g").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))

    @staticmethod
    def still_open(index: DataFrame, spans: DataFrame) -> DataFrame:
        """Rows of the index under shingles that stand in several components; spans are the least and the greatest of each group."""
        rows = index.join(spans, "g")
        spread = rows.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least != most").select("token")
        return rows.join(spread, "token", "left_semi")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: key, n_shingles, component_id (the least key that links reach, its own included), version (a
    hash of the text, which tells rows under one key apart).

    Two documents link when the Jaccard similarity of their sets of n-word shingles (lower-cased A-Z; the whole
    sequence if there are fewer words) is at least percent / 100, exactly, up to collisions of 64-bit hashes within a
    pair. A null or empty text has no set, links with nothing, and is its own component. Equal rows stay rows; a null
    key gets the component of its text and never names one, unless the component has no other key.
    """
    join = Join(docs, n, percent, key, text)
    rows, comps = join.run()
    classes = join.classes.join(comps, "id", "left").select("id", "key", F.coalesce("comp", "id").alias("comp"))
    least = classes.groupBy("comp").agg(F.min("key").alias("component"))
    named = classes.join(least, "comp").select("id", "component")
    out = rows.join(named, "id", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"), "version")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps one: that under the least key (null keys last), of
    several texts under it the one with the least hash. Empty and null texts are no duplicates of one another, but equal
    (key, text) are one row: that whose other columns come first as JSON."""
    found = near_duplicates(docs.select(key, text), key, text, n, percent)
    own_key, version = fresh(docs, "key_", "version_")
    first = found.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias(own_key), F.col("n_shingles") > 0).agg(F.min("version").alias(version))
    same = docs[key].eqNullSafe(F.col(own_key)) & (F.hash(docs[text]) == F.col(version))
    kept = docs.join(first.select(own_key, version), same, "left_semi")
    others = [c for c in docs.columns if c not in (key, text)]
    if not others:
        return kept.dropDuplicates([key, text])
    rest = F.struct(*(F.col(f"`{c}`") for c in others))
    once = kept.groupBy(key, text).agg(F.min_by(rest, F.to_json(rest)).alias(own_key))
    return once.select(*(F.col(c) if c in (key, text) else F.col(own_key)[c].alias(c) for c in docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("version")
