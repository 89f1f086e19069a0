"""Removal of repeated runs of lines by winnowing over line hashes.

In every window of `run` lines, the least line hash is selected; a line selected in several neighbouring windows is one
fingerprint. So any run of at least `run` lines that stands twice shares a fingerprint at the same place in it. A table
holds the position of each fingerprint whose hash occurs several times, with the lines on both sides of it. Positions
are joined by fingerprint to the earliest of them, and each pair is extended to both sides, line by line, until the
lines differ or other fingerprints carry the match on; what makes a run of `run` lines or more repeats. A common line
stands in several contexts, of which the earliest position shows one: windows that no extension has reached are met
once more among themselves, by all their lines. What stands later is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import discard, slices, table, tidy, written
from tasteframe.llm.substrings import cut_windows, in_bitmap, keyed, repeated_minimizers
from tasteframe.llm.windows import joined_hashes, minimizers, rolling, signed, word_hashes

#: Tasks among which the positions of one fingerprint are dealt.
SALTS = 8


class Lines:
    """A text as its lines that hold a word, without white space at their ends; other lines are always kept."""

    @staticmethod
    def split(text: bytes) -> list[bytes]:
        return [line for line in map(bytes.strip, text.split(b"\n")) if line]

    @staticmethod
    def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return joined_hashes([Lines.split(text) for text in texts.to_pylist()])

    @staticmethod
    def keep(text: bytes, units: list[bytes], kept: np.ndarray) -> bytes:
        if kept.all():
            return text
        flags = iter(kept.tolist())
        return b"\n".join([line for line in text.split(b"\n") if not line.strip() or next(flags)])


def around(x: np.ndarray, at: np.ndarray, step: int, most: int) -> pa.Array:
    """For every position the values next to it in one direction, the nearest first; null beyond the end."""
    where = at[:, None] + step * np.arange(1, most + 1)
    outside = (where < 0) | (where >= len(x))
    flat = pa.array(signed(x[np.where(outside, 0, where)].ravel()), mask=outside.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * most), flat)


def positions(docs: DataFrame, run: int, key: str, text: str) -> DataFrame:
    """A row for every position selected by winnowing whose line occurs several times, but for what a bitmap of fixed
    size lets pass besides: key, version, pos, starts (of the windows in which it is selected), the line itself and
    those before and after it. Windows that started earlier in their document need no partner: they are the starts of
    one row a document, without a position."""
    rows = keyed(docs, key, text)
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_minimizers(rows, run, 1, Lines))
    most = max(1, run - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = []
                for i, lines in enumerate(map(Lines.split, part.column(2).to_pylist())):
                    x = word_hashes(lines)
                    h, at = minimizers(x, run, 1)
                    own = np.nonzero(in_bitmap(bitmap.value, h))[0]
                    if not len(own):
                        continue
                    again = np.ones(len(own), dtype=bool)
                    again[np.unique(rolling(x, run)[own], return_index=True)[1]] = False
                    pos, first = np.unique(at[own[~again]], return_index=True)
                    rest = 1 if again.any() else 0
                    starts = np.concatenate([own[~again], own[again]])
                    edges = np.concatenate([first, [len(own) - again.sum()], [len(own)] * rest]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(starts.astype(np.int32)))
                    of = pa.array(np.full(len(pos) + rest, i))
                    none = pa.nulls(rest)
                    own_lines = (pa.array(pos.astype(np.int32)), pa.array(signed(x[pos])), around(x, pos, -1, most), around(x, pos, 1, most))
                    place, line, before, after = (pa.concat_arrays([c, none.cast(c.type)]) for c in own_lines)
                    columns = [part.column(0).take(of), part.column(1).take(of), place, lists, line, before, after]
                    found.append(pa.RecordBatch.from_arrays(columns, names=["key", "version", "pos", "starts", "line", "before", "after"]))
                if found:
                    yield from pa.Table.from_batches(found).combine_chunks().to_batches()

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(tidy(find), f"key {kind}, version int, pos int, starts array<int>, line long, before array<long>, after array<long>")


def equal_lines(x: Column, y: Column) -> Column:
    """How many lines agree from the first on."""
    same = F.zip_with(x, y, lambda a, b: F.coalesce(a == b, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def beside_first(rows: DataFrame, by: str, *carried: str) -> DataFrame:
    """The rows whose value of `by` stands several times, each with the first of them (key, version and what is carried)
    and whether it is `later` than that, under a larger key; a null key is largest.

    The first is one row a value, copied to a few salts: so a value that a large part of the documents hold is dealt
    among tasks."""
    place = F.struct(F.col("key").isNull().alias("none"), "key", *carried, "version")
    first = rows.groupBy(by).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(by, "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "version"), F.lit(SALTS)).cast("int"))
    later = (F.col("key") > F.col("first.key")) | (F.col("key").isNull() & ~F.col("first.none"))
    return salted.join(first, [by, "salt"]).withColumn("later", F.coalesce(later, F.lit(False)))


def extended(found: DataFrame, run: int) -> DataFrame:
    """A row for every window of the written positions that may repeat another document's: key, version, start, its
    lines, and whether it is `reached`: part of a match with the earliest position of its fingerprint. Windows of that
    position itself stand nowhere earlier, so they are left out."""
    pairs = beside_first(found.where("pos is not null"), "line", "pos", "before", "after")
    low = F.col("pos") - equal_lines(F.col("before"), F.col("first.before"))
    high = F.col("pos") + equal_lines(F.col("after"), F.col("first.after"))
    lines = F.concat(F.reverse("before"), F.array("line"), F.col("after"))
    itself = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("version") == F.col("first.version")) & (F.col("pos") == F.col("first.pos"))
    pairs = pairs.where(~itself).select("key", "version", "pos", "later", low.alias("low"), high.alias("high"), lines.alias("lines"), F.explode("starts").alias("start"))
    reached = F.col("later") & (F.col("start") >= F.col("low")) & (F.col("start") + (run - 1) <= F.col("high"))
    window = F.slice("lines", F.col("start") - F.col("pos") + (max(1, run - 1) + 1), run)
    return pairs.select("key", "version", "start", reached.alias("reached"), F.when(~reached, window).alias("window"))


def repeated_runs(found: DataFrame, judged: DataFrame) -> DataFrame:
    """key, version, starts: the starts of windows that also start earlier, from the written positions and windows.

    All places of a window share its fingerprint. Where the earliest position of that fingerprint holds the window, it is
    reached at every other; where not, at none: so what has not been reached is compared among itself."""
    rest = beside_first(judged.where("not reached"), "window").where("later")
    starts = found.where("pos is null").select("key", "version", F.explode("starts").alias("start"))
    starts = starts.unionByName(judged.where("reached").select("key", "version", "start")).unionByName(rest.select("key", "version", "start"))
    return starts.groupBy("key", "version").agg(F.collect_set("start").alias("starts"))


def cut_repeated_lines(docs: DataFrame, run: int = 3, key: str = "doc_id", text: str = "text", kept: str = "kept") -> DataFrame:
    """docs with n_lines, n_removed and the kept lines joined by line feeds.

    A line goes if it lies in a run of `run` or more lines that also stands earlier: in a document with a smaller key
    (a null key is largest), or earlier in the same one. Lines count if they hold a word and are equal but for white
    space at their ends; lines without a word neither count nor go. Runs are judged on the input. A null text is empty.
    Rows under one key, or without a key, do not repeat one another. Columns named n_lines, n_removed or as `kept` are replaced.
    """
    found = written(positions(docs.select(key, text), run, key, text), "positions")
    judged = written(extended(found, run), "windows")
    repeats = written(repeated_runs(found, judged), "repeats")
    discard(found, judged)
    return cut_windows(docs, repeats, run, Lines, key, text, kept, ("n_lines", "n_removed"))


def op1_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
