"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector, less the mean of all, is rotated at random; its code is the signs of the rotated components, with two
correction scalars (its length, and the cosine between code and vector). From code and scalars, the inner product with
a query is estimated without bias, with a bound on the error that shrinks with the dimension. The k-th exact score
among the best by estimate is a floor; candidates whose upper bound reaches it are reranked with their original vectors,
the others are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasteframe.llm.common import table, written


def rotation(dimension: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and vector of the rows that take part: with a key, not null, not zero, no null or non-finite component. A
    key that stands in several rows counts once, with its smallest vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite & F.exists(vector, lambda x: x != 0))
    return good.groupBy(key).agg(F.min(vector).alias(vector))


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """A table of all valid vectors with their codes and scalars, and the mean. The most frequent dimension counts;
    vectors of another take no part. The mean and the counts are those of all rows."""
    good = valid(vectors, key, vector)
    sizes = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0].d if sizes else 1
    good = good.where(F.size(vector) == dimension)
    mean = good.agg(*(F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dimension))).first()
    centre, turn = np.array([x or 0.0 for x in mean]), rotation(dimension)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = matrix(batch.column(1), dimension) - centre
            length = np.linalg.norm(rest, axis=1)
            turned = rest @ turn / np.maximum(length, 1e-300)[:, None]
            cosine = np.abs(turned).sum(axis=1) / np.sqrt(dimension)
            codes = np.packbits(turned > 0, axis=1)
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], type=pa.binary()), pa.array(length), pa.array(np.maximum(cosine, 1e-6))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, vector, "code", "length", "cosine"])

    schema = good.select(key, vector).schema.add("code", "binary").add("length", "double").add("cosine", "double")
    return written(good.select(key, vector).mapInArrow(encode, schema), "codes"), centre


def search(
    vectors: DataFrame,
    queries: str,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    query_block: int = 2048,
    candidate_block: int = 8192,
    width: float = 1.9,
) -> DataFrame:
    """The k nearest vectors of each query by inner product: query_id, rank from 1, vec_id, score; nearest first, ties
    to the smaller key, all candidates if there are fewer than k. Queries are the valid rows for which the SQL
    condition `queries` holds; candidates are all valid rows but the query's own.

    Queries and candidates are compared block by block, a pair of blocks to a task. Of vectors that are equal, the
    k + 1 with the smallest keys are candidates: no other can be among the k nearest. The error bound holds for a
    candidate with a probability that `width` sets (in standard deviations); so recall is near one, not guaranteed.
    """
    codes, centre = index(vectors, key, vector)
    by_value = Window.partitionBy(vector).orderBy(key)
    candidates = codes.withColumn("copy", F.row_number().over(by_value)).where(F.col("copy") <= k + 1).drop("copy")
    asked = codes.where(F.expr(queries)).select(F.col(key).alias("query_id"), F.col(vector).alias("query"))
    n_candidates = max(1, -(-codes.count() // candidate_block))
    n_queries = max(1, -(-asked.count() // query_block))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select(deal(key, n_candidates).alias("cb"), every(n_queries).alias("qb"), key, vector, "code", "length", "cosine")
    right = asked.select(every(n_candidates).alias("cb"), deal("query_id", n_queries).alias("qb"), "query_id", "query")

    def compare(block: pa.Table, wanted: pa.Table) -> pa.Table:
        if not block.num_rows or not wanted.num_rows:
            return pa.table({"query_id": wanted["query_id"][:0], key: block[key][:0], "score": pa.array([], type=pa.float64())})
        return pa.table(dict(zip(("query_id", key, "score"), map(pa.array, nearest(block, wanted, centre, k, key, vector, width)), strict=True)))

    kind = codes.schema[key].dataType.simpleString()
    found = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(compare, f"query_id {kind}, `{key}` {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", key, "score")


def nearest(
    block: pa.Table, wanted: pa.Table, centre: np.ndarray, k: int, key: str, vector: str, width: float, rows: int = 128
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Within one pair of blocks: query keys, candidate keys and exact scores of the best k, ties to the smaller key."""
    block, dimension = block.sort_by(key), len(centre)
    keys, originals = block[key].to_numpy(), matrix(block[vector], dimension)
    packed = np.frombuffer(b"".join(block["code"].to_pylist()), dtype=np.uint8).reshape(len(keys), -1)
    signs = np.unpackbits(packed, axis=1, count=dimension) * 2.0 - 1
    length, cosine = block["length"].to_numpy(), block["cosine"].to_numpy()
    scale = length / cosine / np.sqrt(dimension)
    # what rounding may add to an estimate is far below 1e-9 of the lengths
    slack = length * np.sqrt(np.maximum(1 - cosine**2, 0)) / cosine * width / np.sqrt(max(dimension - 1, 1)) + 1e-9 * (length + np.linalg.norm(centre))
    asked, queries, turn = wanted["query_id"].to_numpy(), matrix(wanted["query"], dimension), rotation(dimension)
    few = 3 * k
    out: list[tuple] = []
    for at in range(0, len(asked), rows):
        q, own = queries[at : at + rows], asked[at : at + rows]
        estimate = (q @ turn) @ signs.T * scale + (q @ centre)[:, None]
        bound = np.linalg.norm(q, axis=1)[:, None] * slack
        other = own[:, None] != keys
        keep = other.copy()
        if len(keys) > few:
            # exact scores of the best by estimate: their k-th is no more than the k-th of all
            top = np.argpartition(np.where(other, estimate, -np.inf), len(keys) - few, axis=1)[:, len(keys) - few :]
            exact = np.einsum("ij,ikj->ik", q, originals[top])
            exact[~np.take_along_axis(other, top, axis=1)] = -np.inf
            least = np.partition(exact, few - k, axis=1)[:, few - k]
            keep &= estimate + bound >= least[:, None]
            np.put_along_axis(keep, top, np.take_along_axis(other, top, axis=1), axis=1)
        chosen, which = np.nonzero(keep)
        score = np.einsum("ij,ij->i", q[chosen], originals[which])
        order = np.lexsort((which, -score, chosen))
        chosen, which, score = chosen[order], which[order], score[order]
        place = np.arange(len(chosen)) - np.searchsorted(chosen, chosen)
        best = place < k
        out.append((own[chosen[best]], keys[which[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def op7_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    found = search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
