"""Toxicity by weak supervision.

Voters are lexicon words and patterns: word stems, word beginnings of fixed length, and character marks. Which of them
say anything is found from counts over the labelled training texts. A generative label model then estimates each
voter's accuracy from how voters agree with one another on all training texts, labelled or not, with the label as a
latent variable; voters that agree far beyond what their accuracies explain are correlated, and share one vote. Its
posteriors are the soft labels of a linear classifier over hashed features of the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import LOWER, UPPER, discard, slices, table, text_bytes, written
from tasteframe.llm.substrings import in_bitmap, repeated_bitmap

MARKS = ".,!?;:%*&$#|\"'()[]{}<>-_/\\«»„“”¡¿"
#: Digits and signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")
BEGINNINGS = range(3, 13)
#: Posterior of a text on which every voter abstains.
SILENT = 0.01
#: Parts with which abstentions may count; the labelled training texts decide.
SILENCE = (1.0, 0.5, 0.25, 0.0)
CAPITALS, SMALL = UPPER.encode(), LOWER.encode()
#: Words that a worker remembers; it starts anew when full. With all their features, a worker remembers fewer, those used last.
CACHE, SPELLED = 400_000, 1 << 16


def word_features(word: bytes, starts: set[str] | None = None) -> tuple[str, ...]:
    """A word's stem, its beginnings, and the stem with digits and signs read as letters. With starts, beginnings only if
    the shortest is among them."""
    whole = word.decode("utf-8", "replace").lower()
    stem = whole.strip(MARKS)
    if not stem:
        return ()
    out = ["w:" + stem]
    if starts is None or stem[: BEGINNINGS[0]] in starts:
        out += ["p:" + stem[:k] for k in range(BEGINNINGS[0], min(BEGINNINGS.stop, len(stem)))]
    plain = stem.translate(LEET)
    if plain != stem and plain.isalpha() and any(c.isalpha() for c in stem):
        out.append("w:" + plain)
    return tuple(out)


def text_features(text: bytes) -> list[str]:
    """Patterns of the whole text: shouting, and marks in a row."""
    capitals, small = (len(text) - len(text.translate(None, x)) for x in (CAPITALS, SMALL))
    letters = capitals + small
    return [name for name, holds in (("x:capitals", capitals * 2 > letters), ("x:bangs", b"!!" in text), ("x:signs", b"***" in text)) if holds]


class Finder:
    """The numbers of the known features in a text, each once."""

    def __init__(self, number: dict[str, int]):
        self.number, self.empty, self.known = number, set(), {}
        self.starts = {f[2 : 2 + BEGINNINGS[0]] for f in number if f.startswith("p:")}

    def find(self, text: bytes) -> set[int]:
        if len(self.empty) + len(self.known) > CACHE:
            self.empty.clear()
            self.known.clear()
        known, number = self.known, self.number
        out = {number[f] for f in text_features(text) if f in number}
        # most words have no known feature: those met before go at once
        for word in set(text.lower().split()) - self.empty:
            own = known.get(word)
            if own is None:
                own = tuple(number[f] for f in word_features(word, self.starts) if f in number)
                if not own:
                    self.empty.add(word)
                    continue
                known[word] = own
            out.update(own)
        return out


@dataclass
class LabelModel:
    """Prior and, of each voter, the log ratios of the two labels that its vote and its silence add; voters of one
    correlated group share. Rows on which all voters abstain tell nothing about the label: theirs is a fixed small
    posterior."""

    prior: float
    votes: np.ndarray
    silence: np.ndarray
    groups: np.ndarray

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        return self.of(*np.nonzero(fired), len(fired))

    def of(self, row: np.ndarray, voter: np.ndarray, n: int) -> np.ndarray:
        """Posteriors of n rows, of which row[i] has the vote of voter[i]."""
        z = np.log(self.prior / (1 - self.prior)) + self.silence.sum() + np.bincount(row, (self.votes - self.silence)[voter], n)
        return np.where(np.bincount(row, minlength=n) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), SILENT)


def _maximised(yes: np.ndarray, no: np.ndarray, yes_all: float, no_all: float, silence: float, groups: np.ndarray) -> LabelModel:
    """The model under which these expected counts are likeliest: of each voter's votes on toxic and other texts, and of
    all those texts. A group of voters shares one vote; a voter says nothing at worst, as it votes toxic."""
    m = len(groups)
    share = 1 / np.bincount(groups, minlength=m)[groups] if m else np.zeros(0)
    a, b = (yes + 0.5) / (yes_all + 1), (no + 0.5) / (no_all + 1)
    a = np.maximum(a, b)
    prior = float(np.clip(yes_all / max(yes_all + no_all, 1.0), 1e-4, 0.5))
    return LabelModel(prior, np.log(a / b) * share, silence * np.log((1 - a) / (1 - b)) * share, groups)


def _linked(mean: np.ndarray, both: np.ndarray, alike: float) -> np.ndarray:
    """Groups of voters, by least number, from how often each votes and each two do on toxic texts."""
    m = len(mean)
    groups = np.arange(m)
    scale = np.sqrt(np.maximum(np.diag(both) - mean**2, 1e-12))
    near = (both - np.outer(mean, mean)) / np.outer(scale, scale) > alike
    for j in range(m):  # the least number that links reach
        groups = np.where(near[j] & (groups > groups[j]), groups[j], groups)
    return groups


def _begun(row: np.ndarray, n: int) -> np.ndarray:
    """Posteriors before there is a model: a text with a vote is toxic."""
    return np.where(np.bincount(row, minlength=n) > 0, 0.9, SILENT)


def fit_label_model(fired: np.ndarray, rounds: int = 25, alike: float = 0.75, silence: float = 1.0) -> LabelModel:
    """fit_patterns of a small table in memory, rows by voters (1: votes toxic, 0: abstains)."""
    (n, m), (row, voter) = fired.shape, np.nonzero(fired)
    groups = np.arange(m)
    for attempt in range(2):
        q = _begun(row, n)
        for _ in range(rounds):
            model = _maximised(np.bincount(voter, q[row], m), np.bincount(voter, (1 - q)[row], m), q.sum(), (1 - q).sum(), silence, groups)
            q = model.of(row, voter, n)
        if attempt == 0 and m:
            w = q / max(q.sum(), 1e-9)
            groups = _linked(w @ fired, fired.T @ (fired * w[:, None]), alike)
    return model


#: Posteriors are summed as whole parts, so that sums do not depend on their order.
PARTS = 1 << 20


def _votes(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Row and voter of each vote."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(model: LabelModel | None, row: np.ndarray, voter: np.ndarray, n: int) -> np.ndarray:
    return np.rint((_begun(row, n) if model is None else model.of(row, voter, n)) * PARTS).astype(np.int64)


def _expected(patterns: DataFrame, models: list[LabelModel | None], m: int) -> np.ndarray:
    """Models x (toxic, other) x voters and all: the expected counts of votes, and of all texts in the last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(models), 2, m + 1), dtype=np.int64)
        for batch in batches:
            (row, voter), times = _votes(batch.column(0)), batch.column(1).to_numpy()
            for k, model in enumerate(models):
                q = _parts(model, row, voter, len(times))
                for side, part in enumerate((q * times, (PARTS - q) * times)):
                    np.add.at(sums[k, side], voter, part[row])
                    sums[k, side, m] += part.sum()
        k, voter = np.nonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(voter.astype(np.int32)), pa.array(sums[k, 0, voter]), pa.array(sums[k, 1, voter])], names=["k", "voter", "yes", "no"])

    out = np.zeros((len(models), 2, m + 1))
    for r in patterns.mapInArrow(run, "k int, voter int, yes long, no long").groupBy("k", "voter").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect():
        out[r.k, :, r.voter] = r.yes / PARTS, r.no / PARTS
    return out


def _groups(patterns: DataFrame, models: list[LabelModel], m: int, alike: float) -> list[np.ndarray]:
    """Each model's groups of correlated voters; sums of pairs of voters come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((len(models), m, m), dtype=np.int64)
        for batch in batches:
            (row, voter), times = _votes(batch.column(0)), batch.column(1).to_numpy()
            fired = np.zeros((len(times), m))
            fired[row, voter] = 1
            for k, model in enumerate(models):
                both[k] += np.rint(fired.T @ (fired * (_parts(model, row, voter, len(times)) * times)[:, None])).astype(np.int64)
        k, i, j = np.nonzero(np.triu(both))
        yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (k, i, j)), pa.array(both[k, i, j])], names=["k", "i", "j", "w"])

    both = np.zeros((len(models), m, m))
    for r in patterns.mapInArrow(run, "k int, i int, j int, w long").groupBy("k", "i", "j").agg(F.sum("w").alias("w")).collect():
        both[r.k, r.i, r.j] = both[r.k, r.j, r.i] = r.w / PARTS
    toxic = np.maximum(_expected(patterns, models, m)[:, 0, m], 1e-9)
    return [_linked(np.diag(b) / n, b / n, alike) for b, n in zip(both, toxic, strict=True)]


def fit_patterns(patterns: DataFrame, m: int, silences: tuple[float, ...] = (1.0,), rounds: int = 25, alike: float = 0.75) -> list[LabelModel]:
    """Accuracies from agreement alone, a model for each of silences: expectation-maximisation with the label as a latent
    class. patterns has votes (array of voters, of m) and n, how many texts have them; a round is one pass over it, of
    which each model's two sums a voter come to the driver. Then voters whose correlation given the label is over
    `alike` are grouped, and the accuracies are estimated again. `silence` is the part of its log ratio with which an
    abstention counts: 1 if voters are independent given the label, less if toxic texts hold few of many words. Rounds
    end early where no figure moves by 1e-6. Without patterns the model has the least prior and voters say nothing."""
    groups = [np.arange(m)] * len(silences)
    for attempt in range(2):
        models: list[LabelModel | None] = [None] * len(silences)
        for _ in range(rounds):
            before = models
            models = [_maximised(yes[:m], no[:m], yes[m], no[m], part, own) for (yes, no), part, own in zip(_expected(patterns, before, m), silences, groups, strict=True)]
            if all(x is not None and abs(x.prior - y.prior) < 1e-6 and np.allclose(x.votes, y.votes, 0, 1e-6) and np.allclose(x.silence, y.silence, 0, 1e-6) for x, y in zip(before, models, strict=True)):
                break
        if attempt == 0:
            if not m:
                break
            groups = _groups(patterns, models, m, alike)
    return models


def _surprise(judged: DataFrame, models: list[LabelModel]) -> list[int]:
    """Of the labels (votes, mark, n), given each model's posteriors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (row, voter), toxic, n = _votes(batch.column(0)), batch.column(1).to_numpy() > 0, batch.column(2).to_numpy()
            q = [np.clip(model.of(row, voter, len(n)), 1e-9, 1 - 1e-9) for model in models]
            sums = [int((np.rint(-np.log(np.where(toxic, x, 1 - x)) * PARTS).astype(np.int64) * n).sum()) for x in q]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(models)), type=pa.int32()), pa.array(sums, type=pa.int64())], names=["k", "s"])

    found = {r.k: r.s for r in judged.mapInArrow(run, "k int, s long").groupBy("k").agg(F.sum("s").alias("s")).collect()}
    return [found.get(k, 0) for k in range(len(models))]


def fit_linear(rows: list[np.ndarray], size: int, target: np.ndarray, rounds: int = 200, penalty: float = 1e-3, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on soft targets over binary features; the last weight is the intercept. A row counts
    times[row] times."""
    times = np.ones(len(rows)) if times is None else times
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    column = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    w, seen = np.zeros(size + 1), np.full(size + 1, 1e-8)
    base = float(np.clip(np.average(target, weights=times), 1e-4, 0.9999)) if len(target) else 0.01
    w[-1] = np.log(base / (1 - base))
    for _ in range(rounds if len(rows) else 0):
        z = np.bincount(row, w[column], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * times
        gradient = np.append(np.bincount(column, error[row], size), error.sum()) / times.sum()
        gradient[:-1] += penalty * w[:-1] / 10
        seen += gradient**2
        w -= 0.5 * gradient / np.sqrt(seen)
    return w


def learn(
    labelled: DataFrame, training: DataFrame, marked: DataFrame, label: str, most_rows: int, most_features: int = 4000, most_voters: int = 150, least: int = 3
) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the features and the classifier's weights, from all labelled texts (text as bytes, label 0/1) and all
    training texts, labelled or not (hash, key, text); marked has the keys of those with a label.

    Labels choose features and voters (precise ones, by document counts). The label model is fitted on the votes on all
    training texts, in Spark (see fit_patterns); how much abstentions count is the choice under which the labels are
    likeliest, the most of equal ones. What the classifier learns is the model's
    posterior, on at most most_rows labelled texts, the first by hash: up to half of them with a vote, the others without, each
    weighed by how many texts of its kind it stands for. Without toxic rows there are no features, and every score is
    that of the prior.
    """
    texts = labelled

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter[str] = Counter()
        toxic: Counter[str] = Counter()
        spelled = lru_cache(SPELLED)(word_features)

        def counted() -> pa.RecordBatch:
            names = list(every)
            out = pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array([every[f] for f in names], type=pa.int64()), pa.array([toxic[f] for f in names], type=pa.int64())], names=["feature", "n", "toxic"])
            every.clear()
            toxic.clear()
            return out

        for batch in batches:
            for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(text_features(text)).union(*map(spelled, set(text.lower().split())))
                every.update(own)
                if mark:
                    toxic.update(own)
                if len(every) > CACHE:
                    yield counted()
        yield counted()

    totals = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("toxic")).first()
    rate = float(totals.toxic or 0) / max(totals.n, 1)
    counts = texts.select("text", label).mapInArrow(count, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    more = (F.col("toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * max(rate * (1 - rate), 1e-9))
    chosen = counts.where((F.col("toxic") >= least)).orderBy(F.desc(F.abs(more)), "feature").limit(most_features).collect() if rate else []
    precise, taken = [], set()
    for i, r in enumerate(chosen):
        stem = r.feature[2:]
        if r.toxic >= 0.8 * r.n and r.toxic >= max(least, 0.005 * float(totals.toxic)) and len(precise) < most_voters:
            # a beginning and its continuation that stand in equally many texts are one voter
            if not any((r.n, stem[:k]) in taken for k in range(1, len(stem) + 1)):
                precise.append(i)
            taken.update((r.n, stem[:k]) for k in range(BEGINNINGS[0], len(stem) + 1))

    # voters have the first numbers
    voters = set(precise)
    order = [*precise, *(i for i in range(len(chosen)) if i not in voters)]
    number = {chosen[i].feature: k for k, i in enumerate(order)}
    if not number:
        return number, fit_linear([], 0, np.zeros(0))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(number)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [sorted(finder.find(t)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, type=pa.list_(pa.int32()))], names=["hash", "key", "features"])

    features = written(training.mapInArrow(look, f"hash long, key {training.schema['key'].dataType.simpleString()}, features array<int>"), "features")
    found = features.withColumn("votes", F.filter("features", lambda x: x < len(precise)))
    lists = lambda column: [x.values.to_numpy() if x.is_valid else np.zeros(0, dtype=np.int32) for x in column]
    flat = lambda rows: (np.repeat(np.arange(len(rows)), np.array([len(r) for r in rows], dtype=np.int64)), np.concatenate([*rows, np.zeros(0, dtype=np.int32)]).astype(np.int64))
    patterns = written(found.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    models = fit_patterns(patterns, len(precise), SILENCE)
    judged = found.join(marked, "key").groupBy("votes", label).agg(F.count(F.lit(1)).alias("n"))
    surprise = _surprise(judged, models)
    model = models[surprise.index(min(surprise))]
    known = found.join(marked, "key", "left_semi")
    silent, voted = (known.where(holds).count() for holds in ("size(votes) = 0", "size(votes) > 0"))
    rows, weights, room = [], [], most_rows
    for holds, n, most in (("size(votes) > 0", voted, most_rows // 2), ("size(votes) = 0", silent, most_rows)):
        own = lists(known.where(holds).orderBy("hash", "features").select("features").limit(min(most, room)).toArrow()["features"])
        rows += own
        weights += [n / max(len(own), 1)] * len(own)
        room -= len(own)
    discard(patterns, features)
    target = model.of(*flat([r[r < len(precise)] for r in rows]), len(rows))
    return number, fit_linear(rows, len(number), target, times=np.array(weights))


def score(
    docs: DataFrame, labels: DataFrame, held_out: str, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 20_000
) -> DataFrame:
    """A row per document: key, held_out, score (0 to 1).

    Learns from all rows for which the SQL condition `held_out` does not hold, labelled or not; only the final linear fit
    is on at most most_rows of them (see learn). Every document is scored. A null or empty text has no features and gets the score of the intercept. A key
    labelled twice counts as toxic if either label does; null labels and keys do not count. Equal rows stay rows.
    """
    held = F.coalesce(F.expr(held_out), F.lit(False))
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held).groupBy(key).agg(F.max(label).alias("mark_"))
    judged = marked = written(marked, "marked")
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(marked.select(F.xxhash64(key).alias("h"), F.lit(2).alias("n"))))

    def to_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(bitmap.value, batch.column(0).to_numpy().view(np.uint64))))

    # only texts that may have a label are shuffled; the bitmap may let more pass, never fewer
    training = text_bytes(docs.where(~held).select(F.xxhash64(key).alias("hash"), key, text), "hash", F.col(key).alias("key"), text=text)
    marked = marked.select(F.col(key).alias("key"), F.col("mark_").cast("int").alias("mark_"))
    texts = training.mapInArrow(to_join, training.schema).join(marked, "key").select("text", "mark_")
    learned = docs.sparkSession.sparkContext.broadcast(learn(texts, training, marked, "mark_", most_rows))
    discard(judged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights = learned.value
        finder, weights = Finder(number), weights.tolist()
        for batch in batches:
            for part in slices(batch, "text"):
                z = [weights[-1] + sum(weights[i] for i in sorted(finder.find(t))) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=[key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return text_bytes(docs.select(key, held.alias("held_out"), text), key, "held_out", text=text).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 4 = 2"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels"), held_out).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
