"""Ranked lexical search by the Best Position Algorithm over impact lists.

Documents are dealt into shards of a few thousand. In a shard, each term of the items has an impact list: its documents
by falling contribution. An item reads its lists from the top; whatever document it meets is looked up in all its lists
at once, which gives its whole score and marks its positions there. A list's best position is the end of its unbroken
run of marked positions, from whatever access; what is unseen stands behind it. The item stops as soon as the sum of
contributions just behind the best positions is strictly below the k-th score, so ties are never lost.

Shards are independent: no list is longer than a shard, however frequent its term. Before the search proper, a few rounds
in every shard give scores whose k-th best over all shards is a floor for every shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, slices, table, text_bytes, tidy, written

#: A-Z to a-z; digits, a-z and all that is not ASCII stay; the rest separates terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A text is cut into terms in pieces of about this many bytes.
PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in runs, so that a very long text is never a list as a whole."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def postings(docs: DataFrame, known: dict[bytes, int], key: str, text: str) -> DataFrame:
    """Per document with at least one term: key, n (its terms with repeats), and its known terms, ascending, with how
    often each occurs. A null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                kept, lengths, which, times = [], [], [], []
                for i, value in enumerate(batch.column(1)):
                    n, found = 0, []
                    for run in terms(value.as_py()):
                        n += len(run)
                        found.append(np.fromiter((known[w] for w in run if w in known), dtype=np.int32))
                    if n:
                        ids, counts = np.unique(np.concatenate(found), return_counts=True)
                        kept.append(i)
                        lengths.append(n)
                        which.append(ids)
                        times.append(counts)
                ends = np.cumsum([0, *map(len, which)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(ends, np.concatenate(x).astype(kind) if x else np.zeros(0, kind)) for x, kind in ((which, np.int32), (times, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), *lists], names=[key, "n", "terms", "times"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n long, terms array<int>, times array<long>"
    return text_bytes(docs, key, text=text).mapInArrow(tidy(count), schema)


@dataclass(frozen=True)
class Asked:
    """A block of items: per item the numbers of its terms and their repeats; per term its weight."""

    items: list[tuple[np.ndarray, np.ndarray]]
    weights: np.ndarray
    documents: int
    length: int


class Shard:
    """The impact lists of some documents, one behind the other, and where each document stands in them. Documents are
    numbered by ascending key, null last."""

    def __init__(self, n: np.ndarray, ends: np.ndarray, term: np.ndarray, times: np.ndarray, asked: Asked):
        self.n_docs, self.n_terms = len(n), max(1, len(asked.weights))
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 100 - 75 + 75 * n.astype(np.int64) * asked.documents // max(1, asked.length)
        impact = asked.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        some = impact > 0
        doc, term, impact = doc[some], term[some].astype(np.int64), impact[some]
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(self.n_terms + 1))
        names = self.doc * self.n_terms + term[order]
        self.position = np.argsort(names)
        self.names = names[self.position]
        self.marked, self.seen = np.zeros(len(names), dtype=bool), np.zeros(len(n), dtype=bool)

    def look_up(self, docs: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: where each document stands in each list, and whether it does."""
        wanted = docs[:, None] * self.n_terms + lists
        at = np.minimum(np.searchsorted(self.names, wanted), max(0, len(self.names) - 1))
        return self.position[at], self.names[at] == wanted

    def best(self, lists: np.ndarray, repeats: np.ndarray, k: int, floor: int, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best, ties to the smaller number; what scores below the floor may be missing.
        With `rounds`, only that many are run: scores are exact, but better documents may be unseen."""
        there = self.starts[lists + 1] > self.starts[lists]
        lists, repeats = lists[there], repeats[there]
        first, last = self.starts[lists], self.starts[lists + 1]
        behind = first.copy()  # just behind the best position
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        touched: list[np.ndarray] = []
        depth, step, seen = 0, 1, []
        while len(lists):
            parts = [self.doc[a + depth : min(a + depth + step, b)] for a, b in zip(first, last, strict=True)]
            fresh = np.unique(np.concatenate(parts))
            fresh = fresh[~self.seen[fresh]]
            if len(fresh):
                self.seen[fresh] = True
                seen.append(fresh)
                position, hit = self.look_up(fresh, lists)
                score = (np.where(hit, self.impact[position], 0) * repeats).sum(axis=1)
                self.marked[position[hit]] = True
                touched.append(position[hit])
                docs, scores = top(np.concatenate((docs, fresh)), np.concatenate((scores, score)), k)
            for i, (a, b) in enumerate(zip(behind, last, strict=True)):
                if a < b and self.marked[a]:
                    run = self.marked[a:b]
                    free = int(run.argmin())
                    behind[i] = b if run[free] else a + free
            open_ = behind < last
            threshold = int((self.impact[behind[open_]] * repeats[open_]).sum())
            rounds = None if rounds is None else rounds - 1
            if not open_.any() or threshold < max(floor, int(scores[-1]) if len(scores) == k else 0) or rounds == 0:
                break
            depth, step = depth + step, step * 2
        for x in touched:
            self.marked[x] = False
        for x in seen:
            self.seen[x] = False
        return docs, scores


def top(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, -scores))[:k]
    return docs[order], scores[order]


def search(lists: DataFrame, asked: Asked, floors: list[int], k: int, key: str, rounds: int | None = None) -> DataFrame:
    """The k best documents of each item in each shard (a batch of rows): item (its number in the block), key, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "terms", 8 << 20):
                batch = pa.Table.from_batches([batch]).sort_by(key).combine_chunks()
                term, times = (batch[c].combine_chunks() for c in ("terms", "times"))
                ends = np.concatenate(([0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False))))
                shard = Shard(batch["n"].to_numpy(), ends, term.flatten().to_numpy(), times.flatten().to_numpy(), asked)
                found = [shard.best(*item, k, floor, rounds) for item, floor in zip(asked.items, floors, strict=True)]
                docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True))
                number = np.repeat(np.arange(len(found)), [len(d) for d, _ in found])
                good = scores >= np.maximum(1, np.asarray(floors))[number]
                names = batch[key].combine_chunks().take(pa.array(docs[good]))
                yield pa.RecordBatch.from_arrays([pa.array(number[good].astype(np.int32)), names, pa.array(scores[good])], names=["item", key, "score"])

    schema = lists.select(key).schema
    return lists.mapInArrow(tidy(run), f"item int, `{key}` {schema[key].dataType.simpleString()}, score long")


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = 2000, rounds: int = 4
) -> DataFrame:
    """The k documents of highest score for each item, scores above 0, ties to the smaller key (null last): item, rank
    from 1, key, score. An item of fewer such documents has them all; one without terms, or none of whose terms occurs,
    has no rows.

    Every row of docs is a document, equal rows too; null and empty texts are none. Rows of items under one id are one
    item: their different texts together, equal rows once. Extra columns are not read. Items are worked through in
    blocks of `block`, whose terms and weights go to every task; the documents of each block are read once and their
    postings for its terms written.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    one = items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    one = one.groupBy("item").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text"))
    one = written(one.withColumn("place", F.row_number().over(Window.orderBy("item")) - 1), "items")  # one narrow row an item
    out = spark.createDataFrame([], f"place long, rank int, `{key}` {kind}, score long")
    for at in range(0, one.count(), block):
        rows = one.where(F.col("place").between(at, at + block - 1)).orderBy("place").collect()
        out = out.unionByName(_rank_block(docs, [r.text.encode() for r in rows], at, k, key, text, rounds))
    named = out.join(one.select("place", F.col("item").alias(item)), "place")
    return named.select(item, "rank", key, "score")


def _rank_block(docs: DataFrame, texts: list[bytes], at: int, k: int, key: str, text: str, rounds: int) -> DataFrame:
    words = [[w for run in terms(t) for w in run] for t in texts]
    known = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
    lists = written(postings(docs, known, key, text), "postings")
    size = lists.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holding = {r.term: r["count"] for r in lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.zeros(len(known), dtype=np.int64)
    for term, df in holding.items():
        weights[term] = math.floor(1000 * math.log((2 * size.documents + 2) / (2 * df + 1)))
    items = [np.unique(np.array([known[w] for w in ws], dtype=np.int64), return_counts=True) for ws in words]
    asked = Asked(items, weights, size.documents, size.length)
    best = lambda c: F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), *c))
    early = search(lists, asked, [0] * len(items), k, key, rounds).select("item", "score")
    floors = [0] * len(items)
    for r in early.withColumn("rank", best([])).where(F.col("rank") == k).collect():
        floors[r.item] = r.score
    found = search(lists, asked, floors, k, key).withColumn("rank", best([F.asc_nulls_last(key)])).where(F.col("rank") <= k)
    ranked = written(found.select((F.col("item") + F.lit(at)).cast("long").alias("place"), "rank", key, "score"), "ranked")
    discard(lists)
    return ranked


def op11_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
