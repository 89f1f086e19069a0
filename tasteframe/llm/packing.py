"""Packing of examples into training sequences as vector bin packing.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. The dot-product heuristic fills one
sequence after the other: of the examples that still fit, it takes the one whose demand has the largest dot product
with what is left of the limits. Only when none fits is the best one cut to fill the sequence. Each task packs its own
documents, so nothing moves between executors; what is left at the end of a task goes into sequences whose length is a
power of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasteframe.llm.common import gather, slices, table, tidy

#: Marks that the tokenizer splits from a letter before them.
TAIL = b".,!?;:%*&$#"


class Words(dict):
    """Numbers of words, given in turn as they are first asked for, and their token ids once these are known."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.flat, self.starts, self.lengths, self.chars = array("i"), array("q"), array("q"), 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.starts) + len(self.new)
        self.new.append(word)
        return number

    def learn(self, ids: list) -> None:
        """The token ids of the new words, in turn."""
        for word, own in zip(self.new, ids, strict=True):
            self.starts.append(len(self.flat))
            self.lengths.append(len(own))
            self.flat.extend(own)
            self.chars += len(word)
        self.new.clear()

    def ids(self, word: bytes) -> array | None:
        """The token ids of a word, if they are known."""
        number = self.get(word)
        if number is None or number >= len(self.starts):
            return None
        start = self.starts[number]
        return self.flat[start : start + self.lengths[number]]

    def held(self) -> int:
        """Bytes, roughly."""
        return 170 * len(self.starts) + self.chars + 4 * len(self.flat)


class WordCache:
    """Token ids of texts by a tokenizer that drops white space: words between ASCII white space are independent. When
    half of what the cache may hold (`most` bytes) is full, a new generation starts and takes over what it needs of the
    one before."""

    def __init__(self, config: str, most: int = 200 << 20):
        self.most = most
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.now, self.before = Words(), Words()

    def _learn(self) -> None:
        """The tokenizer lower-cases, so capitals need not be told apart, unless they could make a special token; marks
        after a letter are tokens of their own."""
        now, before, known, parts = self.now, self.before, [], set()
        for word in now.new:
            own = before.ids(word)
            if own is None:
                stem = word.rstrip(TAIL)
                if len(stem) == len(word) or not stem or not (stem[-1:].isalpha() or stem[-1] > 127 and stem.decode()[-1].isalpha()):
                    parts.add(word)
                else:
                    own = now.ids(stem) or before.ids(stem)
                    tail = word[len(stem) :]
                    parts.add(tail)
                    if own is None:
                        parts.add(stem)
                    own = (own, stem, tail)
            known.append(own)
        ids = self._encode_parts(list(parts))
        now.learn([ids[word] if own is None else own if isinstance(own, array) else [*(ids[own[1]] if own[0] is None else own[0]), *ids[own[2]]] for word, own in zip(now.new, known, strict=True)])

    def _encode_parts(self, parts: list[bytes]) -> dict[bytes, list[int]]:
        """Words of letters alone are encoded many to a text and told apart by the tokens that end a word."""
        texts, out = [p.decode() for p in parts], {}
        single = [i for i, t in enumerate(texts) if not t.isalpha()]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        runs = [letters[at : at + 64] for at in range(0, len(letters), 64)]
        for run, found in zip(runs, self._ids([" ".join(texts[i] for i in run) for run in runs]), strict=True):
            stops = np.nonzero(self.ends[found])[0] + 1 if found else ()
            if len(stops) != len(run) or stops[-1] != len(found):
                single += run
                continue
            start = 0
            for i, stop in zip(run, stops.tolist(), strict=True):
                out[parts[i]] = found[start:stop]
                start = stop
        out.update(zip((parts[i] for i in single), self._ids([texts[i] for i in single]), strict=True))
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text, and how many of them each of its words has."""
        if self.now.held() > self.most // 2:
            self.now, self.before = Words(), self.now
        now, codes = self.now, []
        for text in texts:
            own = (text if b"<|" in text else text.lower()).split()
            codes.append(np.fromiter(map(now.__getitem__, own), dtype=np.int64, count=len(own)))
        self._learn()
        flat, starts, lengths = np.array(now.flat).astype(np.uint32), np.array(now.starts), np.array(now.lengths)
        return [(gather(flat, starts[own], lengths[own]), lengths[own]) for own in codes]


@lru_cache(maxsize=1)
def word_cache(config: str, most: int) -> WordCache:
    """One for all tasks of a worker."""
    return WordCache(config, most)


class Packer:
    """Packs a stream of examples. put() and finish() yield pieces: key, start, ids, the example's tokens, sequence,
    offset. At most `window` examples are open at a time."""

    def __init__(self, tokens: int, segments: int, loss_tokens: int, window: int, first_sequence: int):
        self.limits = np.array([tokens, segments, loss_tokens], dtype=np.int64)
        self.window, self.next = window, first_sequence
        self.items: list[tuple] = []  # key, ids, loss-bearing ids before each id (None: all are), start, end
        self.demand = np.zeros((0, 3), dtype=np.int64)
        self._open(tokens)

    def _open(self, tokens: int) -> None:
        self.left, self.placed = self.limits.copy(), []
        self.left[0] = tokens

    def _close(self) -> Iterator[tuple]:
        offset = 0
        for key, ids, _, start, end in self.placed:
            yield key, start, ids[start:end], len(ids), self.next, offset
            offset += end - start
        self.next += bool(self.placed)
        self._open(int(self.limits[0]))

    @staticmethod
    def _need(before, start: int, end: int) -> list[int]:
        return [end - start, 1, end - start if before is None else int(before[end] - before[start])]

    @staticmethod
    def _cut(before, start: int, end: int, left: np.ndarray) -> int:
        """The end of the longest piece from start on that fits."""
        end = min(end, start + int(left[0])) if left[1] > 0 else start
        if before is None:
            return min(end, start + int(left[2]))
        return start + int(np.searchsorted(before[start : end + 1], before[start] + left[2], side="right")) - 1

    def _queue(self, item: tuple) -> None:
        self.items.append(item)
        self.demand = np.concatenate([self.demand, [self._need(*item[2:])]])

    def put(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        before = None if loss is None else np.concatenate([[0], np.cumsum(np.asarray(loss) != 0)])
        start, most = 0, int(self.limits[0])
        while len(ids) - start >= most and self._cut(before, start, start + most, self.limits) == start + most:
            yield key, start, ids[start : start + most], len(ids), self.next, 0  # a whole sequence of a long example
            self.next, start = self.next + 1, start + most
        if start < len(ids):
            self._queue((key, ids, before, start, len(ids)))
        while len(self.items) > self.window:
            yield from self._step()

    def _step(self) -> Iterator[tuple]:
        """Place the best piece, or close the sequence if nothing more fits."""
        fits = (self.demand <= self.left).all(axis=1)
        value = (self.demand / self.limits) @ (self.left / self.limits)
        i = int(np.argmax(np.where(fits, value, -1) if fits.any() else value))
        key, ids, before, start, end = self.items[i]
        stop = self._cut(before, start, end, self.left)
        if stop == start:
            yield from self._close()
            return
        self.placed.append((key, ids, before, start, stop))
        self.left -= self._need(before, start, stop)
        if stop < end:
            self.items[i], self.demand[i] = (key, ids, before, stop, end), self._need(before, stop, end)
        else:
            self.items[i], self.demand[i] = self.items[-1], self.demand[-1]
            self.items.pop()
            self.demand = self.demand[:-1]
        if self.left[0] == 0:
            yield from self._close()

    def finish(self) -> Iterator[tuple]:
        """Whole sequences as long as there is enough for one; then lengths that are powers of two."""
        most = int(self.limits[0])
        while self.items and int(self.demand[:, 0].sum()) >= int(self.left[0]):
            yield from self._step()
        for item in self.placed:
            self._queue(item)
        while self.items:
            self._open(min(most, 1 << (int(self.demand[:, 0].sum()).bit_length() - 1)))
            sequence = self.next
            while self.items and self.next == sequence:
                yield from self._step()
            yield from self._close()


def pack_texts(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = 2048,
    max_segments: int = 256,
    max_loss_tokens: int | None = None,
    window: int = 256,
    keep_ids: bool = True,
    cache_mb: int = 200,
    loss: str | None = None,
) -> DataFrame:
    """Tokenize whole texts, end each with end_id, and pack them.

    Returns a row per piece: the key column, start, length, ids (unless keep_ids is false), ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone. Rows are packed as they come, equal or not, and
    other columns are not used. A worker holds about cache_mb of words and their ids.

    `loss` names an array of words that bear loss, as structs of two numbers (first word, one past the last) in any order; words are runs
    without ASCII white space. Tokens of other words and, if the last word bears none, the end id count against the
    tokens only. A null array means that all bear loss, as does no `loss`. Pairs that are null, empty or beyond the text
    have no effect. The tokenizer must drop white space, so that words between ASCII white space are encoded
    independently; its file is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        config = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = [("start", pa.int64()), ("length", pa.int64()), *([("ids", pa.list_(pa.int32()))] if keep_ids else []), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    names = [key, *(n for n, _ in schema)]
    kinds = {pa.int64(): T.LongType(), pa.list_(pa.int32()): T.ArrayType(T.IntegerType())}
    out = T.StructType([docs.schema[key], *(T.StructField(n, kinds[k]) for n, k in schema)])

    def rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([p[0] for p in pieces], type=kind)]
        for name, of in schema:
            columns.append(pa.array([_field(name, p) for p in pieces], type=of))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_cache(config.value, cache_mb << 20)
        packer = Packer(max_tokens, max_segments, max_loss_tokens or max_tokens, window, TaskContext.get().partitionId() << 36)
        pieces, kind = [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "text", 1 << 20):
                encoded = words.encode(part.column(1).to_pylist())
                spans = part.column(2).to_pylist() if loss else [None] * part.num_rows
                for own, (ids, lengths), pairs in zip(part.column(0).to_pylist(), encoded, spans, strict=True):
                    pieces += packer.put(own, np.append(ids, np.uint32(end_id)), None if pairs is None else loss_mask(lengths, pairs))
                if len(pieces) >= 4096:
                    yield rows(pieces, kind)
                    pieces = []
        pieces += packer.finish()
        if pieces:
            yield rows(pieces, kind)

    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), *([F.col(loss).alias("loss")] if loss else []))
    return source.mapInArrow(tidy(run), out)


def loss_mask(lengths: np.ndarray, pairs: list) -> np.ndarray:
    """For each token of words of these lengths, and the end after them, whether it bears loss."""
    bears = np.zeros(len(lengths), dtype=bool)
    for first, stop in (p.values() for p in pairs if p is not None):
        if first is not None and stop is not None:
            bears[max(0, first) : max(0, stop)] = True
    return np.append(np.repeat(bears, lengths), bears[-1:].any())


def _field(name: str, piece: tuple):
    _, start, ids, tokens, sequence, offset = piece
    return {
        "start": lambda: start,
        "length": lambda: len(ids),
        "ids": lambda: ids.astype(np.int32),
        "ids_crc32": lambda: zlib.crc32(ids.astype("<u4").tobytes()),
        "doc_tokens": lambda: tokens,
        "sequence_id": lambda: sequence,
        "offset": lambda: offset,
    }[name]()


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 tokens and 256 segments."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack_texts(table(spark, sf_dir, "documents"), path, end_id=1, keep_ids=False)
