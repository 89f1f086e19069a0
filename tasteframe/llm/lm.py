"""Likelihood of texts under a subword lattice.

The pieces of a given vocabulary, each with a probability, span every word in many ways; a word's probability is the sum
over all segmentations, by the forward recursion in log space. The vocabulary and its scores are given (its ranks start
the estimate, by Zipf's law); the probabilities are estimated from the training documents' words by
expectation-maximisation over the same lattice. A text is its words, each after a word mark, and one end piece.

A word that stands in training documents is also an edge of the lattice as a whole: with n of N tokens, V known words
and discount D, P(word) = max(n - D, 0) / N + D V / N * (sum over segmentations). So pieces are estimated from distinct
words, which is what the discounted mass stands for, and what no training text holds is priced by its pieces alone.

Words are counted over the whole corpus and scored once each. A document then needs the figures of its own words: those
of frequent words - so frequent that there cannot be more than `most_frequent` of them - are broadcast, the other words
are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tasteframe.llm.common import table, text_bytes, tidy, written

#: Stands for the end of a text among the words: no word holds a space.
END = b" "
BASE = np.uint64(0x9E3779B97F4A7C15)
LN10 = math.log(10)
#: Codes of beginnings are found by their top bits (a table of 4 MB).
SLOT_BITS = 20
SLOT_SHIFT = np.uint64(64 - SLOT_BITS)
#: Words that a task scores at once.
AT_ONCE = 50_000
#: Log10 probabilities are summed as whole multiples of 1 / UNIT: so the order in which a shuffle brings words is no matter.
UNIT = 1 << 32
#: Words longer than this many characters are scored one by one.
LONG = 48


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece model by falling score; single bytes as <0xNN>. Control pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in sorted(ids, key=lambda i: (-model.get_score(i), i))]


class Lattice:
    """Pieces with log probabilities. `logs` has one more entry, for the end of a text."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        self.logs, self.end = logs, float(logs[-1])
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if len(p) == 6 and p.startswith("<0x")}
        self.number = {p: i for i, p in enumerate(pieces) if i not in set(self.byte.values())}
        self.longest = max(map(len, self.number))
        prefixes = {p[:k] for p in self.number for k in range(1, len(p) + 1)}
        codes = np.array([self._hash(p) for p in prefixes], dtype=np.uint64) * BASE
        order = np.argsort(codes)
        # one entry that nothing leads to stands behind the last, for every probe that goes too far
        self.codes = np.append(codes[order], np.zeros(1, dtype=np.uint64))
        self.piece = np.append(np.array([self.number.get(p, -1) for p in prefixes], dtype=np.int64)[order], -1)
        self.first = np.searchsorted(codes[order], np.arange(1 << SLOT_BITS, dtype=np.uint64) << SLOT_SHIFT).astype(np.int32)
        self.most = int(np.bincount((codes >> SLOT_SHIFT).astype(np.int64)).max())

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is that of a beginning of a piece, and where: within the few codes that share its top bits."""
        code = h * BASE
        at = self.first[(code >> SLOT_SHIFT).astype(np.int64)]
        found = (self.codes[at] == code) & (at < len(self.codes) - 1)
        for _ in range(self.most - 1):
            left = np.nonzero(~found)[0]
            at[left] = np.minimum(at[left] + 1, len(self.codes) - 1)
            found[left] = (self.codes[at[left]] == code[left]) & (at[left] < len(self.codes) - 1)
        return found, at

    def by_bytes(self, char: str) -> list[int]:
        """A character that is no piece, as its bytes."""
        return [self.byte[b] for b in char.encode("utf-8", "replace")]

    def _edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """From each position in turn: start, end, rows of the words that have a piece there, its number, its log."""
        n = len(words[0])
        chars = np.array(words, dtype=f"U{n}").view(np.uint32).reshape(len(words), n)
        for i in range(n):
            rows, h = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * BASE + chars[rows, j - 1].astype(np.uint64) + np.uint64(1)
                found, at = self._look_up(h)
                number = np.where(found, self.piece[at], -1)
                is_piece = number >= 0
                if is_piece.any():
                    yield i, j, rows[is_piece], number[is_piece], self.logs[number[is_piece]]
                if j == i + 1 and not is_piece.all():
                    other = rows[~is_piece]
                    value = {c: sum(self.logs[k] for k in self.by_bytes(chr(c))) for c in np.unique(chars[other, i]).tolist()}
                    yield i, j, other, np.full(len(other), -1), np.array([value[c] for c in chars[other, i].tolist()])
                rows, h = rows[found], h[found]
                if not len(rows):
                    break

    def _same_length(self, words: list[str], weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        n = len(words[0])
        ahead = np.full((n + 1, len(words)), -np.inf)
        ahead[0] = 0
        edges = []
        for i, j, rows, number, log in self._edges(words):
            ahead[j, rows] = np.logaddexp(ahead[j, rows], ahead[i, rows] + log)
            if weights is not None:
                edges.append((i, j, rows, number, log))
        if weights is None:
            return ahead[n], None
        expected = np.zeros(len(self.logs))
        behind = np.full((n + 1, len(words)), -np.inf)
        behind[n] = 0
        for i, j, rows, number, log in reversed(edges):
            through = behind[j, rows] + log
            behind[i, rows] = np.logaddexp(behind[i, rows], through)
            share = np.exp(ahead[i, rows] + through - ahead[n, rows]) * weights[rows]
            if number[0] >= 0:
                expected += np.bincount(number, share, len(expected))
            else:
                for row, s in zip(rows.tolist(), share.tolist(), strict=True):
                    for k in self.by_bytes(words[row][i]):
                        expected[k] += s
        return ahead[n], expected

    def score(self, words: list[str], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probability of each word, marked as a word; with weights also the pieces' expected counts."""
        marked = ["▁" + w for w in words]
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(marked):
            by_length.setdefault(len(w), []).append(k)
        out, expected = np.zeros(len(words)), None if weights is None else np.zeros(len(self.logs))
        for n, own in by_length.items():
            step = len(own) if n <= LONG else max(1, 4096 // n)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part], e = self._same_length([marked[k] for k in part], None if weights is None else weights[part])
                if e is not None:
                    expected += e
        return out, expected


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (in training rows), n_all, over the rows (held_out, text as bytes); the end of a text counts as END.
    Counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            n = [seen[0][w] for w in words]
            total = [seen[0][w] + seen[1][w] for w in words]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, type=pa.binary()), pa.array(n, type=pa.int64()), pa.array(total, type=pa.int64())], names=["word", "n", "n_all"])

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                mine = seen[1] if held else seen[0]
                mine.update(text.as_py().lower().split())
                mine[END] += 1
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "word binary, n long, n_all long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of the batches, some AT_ONCE at a time: words are scored by length, and few of a length cost as much as many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= AT_ONCE:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def estimate(counts: DataFrame, pieces: list[str], rounds: int = 3) -> np.ndarray:
    """Log probabilities of the pieces and the end, from the distinct training words. The driver gets one expected count a
    piece, however large the corpus."""
    context = counts.sparkSession.sparkContext
    weights = np.append(1 / (np.arange(len(pieces)) + 10.0), 1.0)
    logs = np.log(weights / weights.sum())
    for _ in range(rounds):
        current = context.broadcast((pieces, logs))

        def run(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(*current.value), np.zeros(len(current.value[1]))
            for part in merged(batches):
                words = part.column(0).to_pylist()
                own = [k for k, w in enumerate(words) if w != END]
                total[-1] += len(words) - len(own)
                total += lattice.score([words[k].decode() for k in own], np.ones(len(own)))[1]
            some = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["piece", "expected"])

        found = counts.where("n > 0").select("word").mapInArrow(run, "piece long, expected double")
        expected = np.full(len(logs), 0.01)
        for r in found.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():
            expected[r.piece] += r.expected
        logs = np.log(expected / expected.sum())
        current.unpersist()
    return logs


def score_documents(
    docs: DataFrame, model_path: str, held_out: str, key: str = "doc_id", text: str = "text", most_frequent: int = 50_000
) -> DataFrame:
    """A row per document: key, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of
    the whole text by an add-one unigram of words, and by the lattice). Rows for which the SQL condition `held_out`
    holds are not learned from. A null or empty text is its end alone; equal rows and repeated keys stay rows. Equal
    texts have equal scores to the last bit: a word's figures are rounded to 2**-32, and their sums are exact.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), text)
    rows = text_bytes(rows, "row", "key", "held_out", text=text)
    counts = written(count_words(rows.select("held_out", "text")), "words")
    pieces = load_pieces(model_path)
    model = spark.sparkContext.broadcast((pieces, estimate(counts, pieces)))
    known = F.col("n") > 0
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", known.cast("long"), (F.col("n") == 1).cast("long"), (F.col("n") == 2).cast("long"), "n_all"))).first()
    train, distinct, once, twice, occurrences = map(int, sums)
    discount = once / (once + 2 * twice) if twice else 0.5
    unseen = math.log(discount * distinct / train) if train else 0.0

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for part in merged(batches):
            words, n = part.column(0).to_pylist(), part.column(1).to_numpy()
            logs = lattice.score([w.decode() for w in words])[0]
            logs[[w == END for w in words]] = lattice.end
            whole = np.log(np.maximum(n - discount, 1e-300) / max(train, 1), where=n > 0, out=np.full(len(n), -np.inf))
            logs = np.rint(np.logaddexp(logs + unseen, whole) / LN10 * UNIT).astype(np.int64)
            yield from pa.table([*part.columns, pa.array(logs)], names=["word", "n", "n_all", "log"]).to_batches()

    priced = written(counts.mapInArrow(tidy(price), "word binary, n long, n_all long, log long"), "priced")
    # more than 1/most_frequent of all occurrences each: so there are fewer than most_frequent of them
    frequent = priced.where((F.col("n_all") * most_frequent > occurrences) & (F.length("word") <= 64))
    figures_of = spark.sparkContext.broadcast({bytes(r.word): (r.n, r.log) for r in frequent.collect()})
    price_of_all = math.log10(train + distinct + 1)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its key and what its frequent words sum up to, and one for each other word of it.
        Row numbers are made and used in this one pass: a second scan might number the rows otherwise."""
        figures = {w: (n > 0, round(math.log10(n + 1) * UNIT), log) for w, (n, log) in figures_of.value.items()}
        common = figures.keys()
        for batch in batches:
            rare: tuple[list, ...] = ([], [], [])
            whole = tuple([] for _ in range(6))
            for n, (row, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3), strict=True)):
                words = Counter(text.as_py().lower().split())
                words[END] += 1
                seen = base = score = 0
                for word in words.keys() & common:
                    k, f = words[word], figures[word]
                    seen += k * f[0]
                    base += k * f[1]
                    score += k * f[2]
                for column, x in zip(whole, (row, b" %d" % row, words.total(), seen, base, score), strict=True):
                    column.append(x)
                own = words.keys() - common
                rare[0].extend([row] * len(own))
                rare[1].extend(own)
                rare[2].extend(map(words.__getitem__, own))
                if len(rare[0]) > 50_000:
                    yield record(rare, batch.column(1).type)
                    rare = ([], [], [])
            yield record(rare, batch.column(1).type)
            yield record(whole, batch.column(1).type, batch.column(1), batch.column(2))

    def record(columns: tuple[list, ...], key_kind: pa.DataType, *of_document: pa.Array) -> pa.RecordBatch:
        """Words have row, word and k alone."""
        names = ["row", "word", "k", "seen", "base", "log_sum", "key", "held_out"]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), key_kind, pa.bool_())
        own = [*(pa.array(c, type=k) for c, k in zip(columns, kinds, strict=False)), *of_document]
        return pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(columns[0]), k) for k in kinds[len(own) :])], names=names)

    kind = docs.schema[key].dataType.simpleString()
    words = rows.mapInArrow(tidy(look_up), f"row long, word binary, k long, seen long, base long, log_sum long, key {kind}, held_out boolean")
    joined = words.join(priced.select("word", "n", "log"), "word", "left")
    whole, k = F.col("seen").isNotNull(), F.col("k")
    sums = joined.groupBy("row").agg(
        F.max("key").alias("key"),
        F.max("held_out").alias("held_out"),
        F.sum(F.when(whole, k)).alias("n_tokens"),
        F.sum(F.when(whole, F.col("seen")).when(F.col("n") > 0, k).otherwise(0)).alias("n_known"),
        F.sum(F.when(whole, F.col("base")).otherwise(k * F.rint(F.log10(F.col("n") + 1) * UNIT).cast("long"))).alias("base"),
        F.sum(F.when(whole, F.col("log_sum")).otherwise(k * F.col("log"))).alias("score"),
    )
    return sums.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") / UNIT - F.col("n_tokens") * F.lit(price_of_all)).alias("base_score"),
        (F.col("score") / UNIT).alias("score"),
    )


def op3_lattice_scores(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    held_out = "crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 7 = 2"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, model_path or public_tokenizers.path("piece_bpe_32k.model"), held_out)
