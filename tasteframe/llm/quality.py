"""Quality rules: a decision list learned by sequential covering, in DataFrame expressions alone.

Statistics of each text are columns. On the labelled rows, a rule is grown condition by condition (threshold on one
statistic, by information gain on the growing part), then pruned to the prefix that does best on the pruning part; the
rows it covers go, and the next rule is grown on the rest. The list is emitted as one ordered conditional expression.
The driver sees only histograms (part x statistic x bin), whose size does not depend on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import UPPER, fresh, table, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test; each is a number for every text, 0 where it has no words.
FEATURES = {
    "symbol_share": "n_symbols / word_chars",
    "upper_share": "n_upper / word_chars",
    "mark_share": "n_marks / word_chars",
    "dup_line_share": "n_dup_lines / n_lines",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct_words / n_words",
    "word_length": "word_chars / n_words",
    "line_words": "n_words / n_lines",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all its conditions; hits and misses are counted on the pruning part."""

    conditions: tuple[Condition, ...]
    hits: int
    misses: int

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: the key, version (a hash of the text), counts of its whole text, and FEATURES. A null or empty text counts 0 throughout.

    Repeated windows are found by sorting 64-bit hashes of the text's own 3-word windows.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    whole, chars = F.col("whole"), F.length("whole")
    base = docs.select(F.col(key), F.hash(text).alias("version"), t.alias("whole"))
    base = base.select(
        key,
        "version",
        F.expr(f"filter(split(whole, '[{r'\\x20\\x09-\\x0D'}]+'), x -> x != '')").alias("words"),
        F.expr(r"filter(split(whole, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        _without(whole, SPACE).cast("long").alias("word_chars"),
        (chars - _without(whole, SYMBOLS)).cast("long").alias("n_symbols"),
        (chars - _without(whole, UPPER)).cast("long").alias("n_upper"),
        (chars - _without(whole, "!?")).cast("long").alias("n_marks"),
    )
    counts = [key, "version", "word_chars", "n_symbols", "n_upper", "n_marks"]
    base = base.select(
        *counts,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.expr("transform(words, (w, i) -> struct(xxhash64(w, get(words, i + 1), get(words, i + 2)) as h, i as i))").alias("windows"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines", "n_distinct_words"]
    base = base.select(*counts, F.expr("sort_array(slice(windows, 1, cast(greatest(n_words - 2, 0) as int)))").alias("windows"))
    base = base.select(*counts, F.expr("sort_array(transform(filter(windows, (x, k) -> x.h = get(windows, k - 1).h or x.h = get(windows, k + 1).h), x -> x.i))").alias("starts"))
    base = base.select(*counts, F.expr("aggregate(transform(starts, (p, k) -> least(3, coalesce(get(starts, k + 1) - p, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"))
    return base.select("*", *(F.coalesce(F.try_divide(*(F.col(c).cast("double") for c in e.split(" / "))), F.lit(0.0)).alias(n) for n, e in FEATURES.items()))


def base_failed() -> Column:
    """Too short, or mostly repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(
    labelled: DataFrame,
    key: str = "doc_id",
    reject: str = "reject",
    features: tuple[str, ...] = tuple(FEATURES),
    bins: int = 20,
    most_rules: int = 10,
    most_conditions: int = 3,
    least_precision: float = 0.9,
    least_hits: int = 3,
) -> list[Rule]:
    """Decision list from all labelled rows (key, features, reject 0/1). Rows with a null label or key do not count;
    without rows of either class there are no rules. Thresholds are quantiles of both classes."""
    rows = labelled.where(F.col(reject).isNotNull() & F.col(key).isNotNull())
    shares = [(i + 0.5) / bins for i in range(bins)]
    found = rows.groupBy(reject).agg(*(F.percentile_approx(f, shares, 10_000).alias(f) for f in features)).collect()
    if len(found) < 2:
        return []
    cuts = {f: sorted({v for r in found for v in r[f]}) for f in features}
    binned = F.array(*(sum(((F.col(f) > F.lit(c)).cast("int") for c in cuts[f]), F.lit(0)) for f in features))
    # a third of the rows prunes: by the key's hash, whatever the order of rows
    rows = written(rows.select(F.col(reject).cast("int").alias("y"), (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 0).alias("prune"), binned.alias("bins")), "labelled")

    def holds(conditions) -> Column:
        out = F.lit(True)
        for f, above, k in conditions:
            out = out & ((F.col("bins")[f] > k) if above else (F.col("bins")[f] <= k))
        return out

    def histogram(df: DataFrame) -> tuple[list[list[list[int]]], list[int]]:
        """Of the growing part [feature][bin][label], and the pruning part's totals by label."""
        got = df.select("y", "prune", F.posexplode("bins").alias("f", "bin")).groupBy("prune", "f", "bin", "y").count().collect()
        grow = [[[0, 0] for _ in range(len(cuts[f]) + 1)] for f in features]
        prune = [0, 0]
        for r in got:
            if not r.prune:
                grow[r.f][r.bin][r.y] += r["count"]
            elif r.f == 0:
                prune[r.y] += r["count"]
        return grow, prune

    rules: list[Rule] = []
    rest = rows
    while len(rules) < most_rules:
        chosen: list[tuple[int, bool, int]] = []
        scored: list[tuple[float, int, int, int]] = []
        grow, _ = histogram(rest)
        while len(chosen) < most_conditions:
            total = [sum(b[y] for b in grow[0]) for y in (0, 1)]
            if not total[1] or not total[0]:
                break
            before, best = math.log2(total[1] / sum(total)), (0.0, None)
            for f, hist in enumerate(grow):
                low = [0, 0]
                for k, b in enumerate(hist[:-1]):
                    low = [low[0] + b[0], low[1] + b[1]]
                    for above, (n, p) in ((False, low), (True, [total[0] - low[0], total[1] - low[1]])):
                        if p >= least_hits and p + n < sum(total):
                            gain = p * (math.log2(p / (p + n)) - before)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, above, k))
            # the bin number counts the thresholds below the value: bin <= k means value <= cuts[k]
            if best[1] is None:
                break
            chosen.append(best[1])
            grow, (misses, hits) = histogram(rest.where(holds(chosen)))
            scored.append(((hits - misses) / max(1, hits + misses), len(chosen), hits, misses))
        if not scored:
            break
        value, length, hits, misses = max(scored, key=lambda s: (s[0], -s[1]))
        if hits < least_hits or hits < least_precision * (hits + misses):
            break
        rules.append(Rule(tuple(Condition(features[f], above, cuts[features[f]][k]) for f, above, k in chosen[:length]), hits, misses))
        rest = rest.where(~holds(chosen[:length]))
    return rules


def rejected_by(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects, from 1; 0 if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.column(), i) if out is None else out.when(rule.column(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> DataFrame:
    """Statistics of all documents with base_failed, rule (the first that rejects, else 0) and kept, by rules learned
    from the labels (key, quality 1: good, 0: bad). A document without a label is judged like any other; a key that
    stands twice is judged per row. The statistics are written once and used for learning and for the verdict."""
    stats = written(statistics(docs, key, text).withColumn("base_failed", base_failed()), "quality")
    marked = labels.where(F.col(quality).isin(0, 1)).groupBy(key).agg(F.min(quality).alias("label_"))
    labelled = stats.where(~F.col("base_failed")).join(marked, key).withColumn("reject", 1 - F.col("label_"))
    rules = learn(labelled, key)
    return stats.withColumn("rule", rejected_by(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns; equal rows stay rows."""
    own_key, version = fresh(docs, "key_", "version_")
    good = judge(docs.select(key, text), labels, key, text).where("kept").select(F.col(key).alias(own_key), F.col("version").alias(version))
    same = docs[key].eqNullSafe(F.col(own_key)) & (F.hash(docs[text]) == F.col(version))
    return docs.join(good, same, "left_semi")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
