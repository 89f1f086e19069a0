"""Removal of repeated passages: every window of fixed length is hashed by Rabin-Karp and counted in Spark.

Two counts follow each other. First the windows' minimizers (the least hash of a shorter window in it; about a sixth as
many as windows): where a minimizer stands at one place of the corpus only, none of its windows repeats. Which
minimizers repeat is broadcast as a bitmap of fixed size; it may let more windows pass, never fewer. Then the windows
that are left, by 96 bits of two hashes: all but the first place of each are repeats, and overlapping repeats merge into
maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasteframe.llm.common import discard, fresh, mixed, slices, table, text_bytes, tidy, written
from tasteframe.llm.windows import BASES, least_parts, rolling, signed, text_hashes

#: Bits of the bitmap: 16 MB, whatever the corpus; and bits of each part of it.
BITMAP_BITS, PART_BITS = 27, 20
#: Bytes of texts that are hashed at once; their arrays take some twenty times as much.
HASHED = 1 << 20


def repeated_bitmap(hashes: DataFrame) -> np.ndarray:
    """The top bits of those hashes (column h, n occurrences) that occur twice or more, as one bitmap. Its parts come to
    the driver in one job: toLocalIterator() would run one for each partition, and the driver remembers every job."""
    repeated = hashes.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bits = repeated.select(F.shiftrightunsigned("h", 64 - BITMAP_BITS).alias("bit")).distinct()

    def part(rows: pa.Table) -> pa.Table:
        flags = np.zeros(1 << PART_BITS, dtype=bool)
        bit = rows["bit"].to_numpy()
        flags[bit & ((1 << PART_BITS) - 1)] = True
        return pa.table({"part": pa.array(bit[:1] >> PART_BITS), "flags": pa.array([np.packbits(flags).tobytes()])})

    out = np.zeros(1 << (BITMAP_BITS - 3), dtype=np.uint8)
    size = 1 << (PART_BITS - 3)
    parts = bits.groupBy(F.shiftright("bit", PART_BITS).alias("part")).applyInArrow(part, "part long, flags binary").toArrow()
    for k, flags in zip(parts["part"].to_pylist(), parts["flags"], strict=True):
        out[k * size : (k + 1) * size] = np.frombuffer(flags.as_buffer(), dtype=np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1


class Words:
    """A text as words; what is kept is joined by one space."""

    split = staticmethod(bytes.split)
    hashes = staticmethod(text_hashes)

    @staticmethod
    def keep(text: bytes, units: list[bytes], kept: np.ndarray) -> bytes:
        return b" ".join(units if kept.all() else compress(units, kept.tolist()))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, version (a hash of the text) and the text as bytes."""
    return text_bytes(docs.select(F.col(key).alias("key"), F.hash(text).alias("version"), text), "key", "version", text=text)


def repeated_minimizers(rows: DataFrame, length: int, short: int, units: type) -> np.ndarray:
    """The bitmap of those minimizers of windows of `length` units that stand at several places."""

    def first_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED):
                h, _, new = least_parts(*units.hashes(part.column(0)), length, short)
                h, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

    return repeated_bitmap(rows.select("text").mapInArrow(tidy(first_count), "h long, n long"))


def started_before(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which hashes stand earlier between the same two of the bounds."""
    again = np.zeros(len(h), dtype=bool)
    for low, high in pairwise(bounds.tolist()):
        own = h[low:high]
        order = own.argsort(kind="stable")
        ordered = own[order]
        again[low + order[1:]] = ordered[1:] == ordered[:-1]
    return again


def repeated_windows(docs: DataFrame, length: int, short: int, units: type, key: str, text: str) -> DataFrame:
    """A written table of key, version (a hash of the text), starts: the starts of windows of `length` units that also
    start earlier, in a document with a smaller key or in the same one. Minimizers are windows of `short` units.

    What repeats within a document is known at once; of two documents, the smaller key decides. So a window needs to
    carry its key only, and the first count of windows a number and the least key. The count is written: what it has
    shuffled goes before the join, in which the rows of a window that many documents hold can be split among tasks.
    """
    rows = keyed(docs, key, text)
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_minimizers(rows, length, short, units))

    def second_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", HASHED):
                x, bounds = units.hashes(part.column(2))
                h, inside, _ = least_parts(x, bounds, length, short)
                own = np.flatnonzero(inside)
                own = own[in_bitmap(bitmap.value, h[own])]
                if len(own):
                    h1, h2 = (rolling(x, length, base)[own] for base in BASES)
                    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[own]
                    starts, again = own - bounds[of], started_before(h1 ^ mixed(h2), np.searchsorted(own, bounds))
                    starts = np.where(again, -starts - 1, starts)
                    columns = [part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(starts.astype(np.int32)), pa.array(signed(h1)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "version", "start", "h1", "h2"])

    kind = docs.schema[key].dataType.simpleString()
    windows = rows.mapInArrow(tidy(second_count), f"key {kind}, version int, start int, h1 long, h2 int")
    first = written(windows.groupBy("h1", "h2").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    later = windows.join(first, ["h1", "h2"]).where("start < 0 or key > least or (key is null and least is not null)")
    start = F.when(F.col("start") < 0, -F.col("start") - 1).otherwise(F.col("start"))
    found = written(later.groupBy("key", "version").agg(F.collect_list(start).alias("starts")), "repeats")
    discard(first)
    return found


def cut_windows(
    docs: DataFrame, found: DataFrame, length: int, units: type, key: str, text: str, kept: str, names: tuple[str, str]
) -> DataFrame:
    """docs with two counts, of units and of removed units, and the kept text, without the windows of `length` units that
    found (key, version, starts), a written table, lists. Only documents that lose something are joined to what they
    lose; a bitmap of fixed size tells the others, which stay where they are."""
    others = [c for c in docs.columns if c not in (*names, kept)]
    own_key, version, its_version, starts, mark = fresh(docs, "key_", "version_", "its_version_", "starts_", "mark_")
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(found.select(F.xxhash64("key").alias("h"), F.lit(2).alias("n"))))
    rows = docs.select(*others).withColumn(version, F.hash(text)).withColumn(mark, F.xxhash64(key))
    plain = T.StructType([docs.schema[c] for c in others])
    schema = T.StructType([*plain, *(T.StructField(n, T.LongType()) for n in names), T.StructField(kept, T.StringType())])

    def losing(part: pa.RecordBatch) -> np.ndarray:
        return in_bitmap(bitmap.value, part.column(mark).to_numpy().view(np.uint64))

    def cut(part: pa.RecordBatch, lost: list) -> pa.RecordBatch:
        total, removed, left = [], [], []
        for value, first in zip(part.column(text), lost, strict=True):
            whole = value.as_buffer().to_pybytes() if value.is_valid else b""
            own = units.split(whole)
            edges = np.zeros(len(own) + 1, dtype=np.int64)
            if first is not None:
                np.add.at(edges, first, 1)
                np.add.at(edges, first + length, -1)
            keep = np.cumsum(edges[:-1]) == 0
            total.append(len(own))
            removed.append(len(own) - int(keep.sum()))
            left.append(units.keep(whole, own, keep))
        columns = [*(part.column(c) for c in others), pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(left, type=pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[*others, *names, kept])

    def whole_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(~losing(batch))), text):
                yield cut(part, [None] * part.num_rows)

    def to_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(losing(batch)))

    def joined_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield cut(part, [x.values.to_numpy() if x.is_valid else None for x in part.column(starts)])

    touched = rows.mapInArrow(to_join, rows.schema)
    same = touched[key].eqNullSafe(F.col(own_key)) & (touched[version] == F.col(its_version))
    joined = touched.join(found.toDF(own_key, its_version, starts), same, "left").select(*others, starts)
    return rows.mapInArrow(tidy(whole_ones), schema).union(joined.mapInArrow(tidy(joined_ones), schema))


def cut_repeats(docs: DataFrame, length: int = 20, key: str = "doc_id", text: str = "text", kept: str = "kept") -> DataFrame:
    """docs with n_words, n_removed and the kept words joined by one space.

    A word goes if it is covered by a window of `length` words whose words also start earlier in the same order: in a
    document with a smaller key (a null key is largest), or earlier in the same one. Windows are those of the input.
    A null or empty text has no words. Rows under one key, or without a key, do not repeat one another. Columns named n_words, n_removed or as `kept` are
    replaced.
    """
    repeats = repeated_windows(docs.select(key, text), length, max(1, length // 2), Words, key, text)
    return cut_windows(docs, repeats, length, Words, key, text, kept, ("n_words", "n_removed"))


def op8_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
