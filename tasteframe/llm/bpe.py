"""Byte-level BPE encoding and decoding over a given table of ranks.

Two tiers: a minimal perfect hash resolves a pre-token that is a vocabulary entry as a whole; any other pre-token is
merged with a heap over linked bytes. A worker keeps what it has resolved in a bounded cache.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasteframe.llm.common import ArrowStep, add_arrow_columns, gather, table

#: Bytes that a worker's cache holds about; it starts anew when full.
CACHE = 150 << 20
MASK = (1 << 64) - 1


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, rank), by rank. Ranks must be 0, 1, 2, ... without gaps."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: as many slots as keys, one probe a lookup.

    Keys fall into buckets; the largest bucket first, each gets the first seed that sends all its keys to free slots.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = len(keys)
        self.size, self.buckets = n, max(1, n // per_bucket)
        seeds, slots = [0] * self.buckets, [-1] * n
        self.keys = keys
        self.digest = hashlib.sha256(b"\n".join(map(base64.b64encode, keys))).hexdigest()
        members: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(key)
            members.setdefault(h % self.buckets, []).append((h, i))
        for bucket, own in sorted(members.items(), key=lambda x: -len(x[1])):
            seed = 0
            while True:
                places = {self._slot(h, seed) for h, _ in own}
                if len(places) == len(own) and all(slots[p] < 0 for p in places):
                    break
                seed += 1
            seeds[bucket] = seed
            for h, i in own:
                slots[self._slot(h, seed)] = i
        self.seeds, self.slots = np.array(seeds, dtype=np.uint64), np.array(slots, dtype=np.int64)

    def _slot(self, h: int, seed: int) -> int:
        x = (h ^ (seed * 0x9E3779B97F4A7C15)) & MASK
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & MASK
        return (x ^ (x >> 29)) % self.size

    def find(self, wanted: list[bytes]) -> list[int]:
        """Each string's index among the keys, or -1 for one that is no key."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, wanted), dtype=np.uint64, count=len(wanted))
        x = h ^ (self.seeds[h % np.uint64(self.buckets)] * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        at = self.slots[(x ^ (x >> np.uint64(29))) % np.uint64(self.size)].tolist()
        keys = self.keys
        return [i if keys[i] == key else -1 for i, key in zip(at, wanted, strict=True)]


class Merger:
    """Merges pre-tokens by ranks: the lowest-ranked adjacent pair first, the leftmost among equals."""

    def __init__(self, keys: list[bytes]):
        rank_of = {key: i for i, key in enumerate(keys)}
        self.byte = [rank_of[bytes([a])] for a in range(256)]
        #: rank of what two neighbouring tokens make, by left << 32 | right
        self.union = {}
        for key, i in rank_of.items():
            for cut in range(1, len(key)):
                if (a := rank_of.get(key[:cut])) is not None and (b := rank_of.get(key[cut:])) is not None:
                    self.union[a << 32 | b] = i

    def merge(self, piece: bytes) -> list[int]:
        """Linked bytes: after[i] and before[i] are the starts of i's neighbours, token[i] its rank, pair[i] the rank
        of its union with the next. A heap entry holds a pair's rank and start; it is stale if pair[i] has changed."""
        n, find, byte = len(piece), self.union.get, self.byte
        token = [byte[a] for a in piece]
        pair = [find(a << 32 | b, -1) for a, b in zip(token, token[1:])]  # noqa: B905
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        if not heap:
            return token
        heapify(heap)
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if pair[i] != r:
                continue
            j = after[i]
            end = after[i] = after[j]
            token[i] = r
            pair[j] = token[j] = -1
            if end < n:
                before[end] = i
                pair[i] = known = find(r << 32 | token[end], -1)
                if known >= 0:
                    heappush(heap, known << 32 | i)
            else:
                pair[i] = -1
            i = before[i]
            if i >= 0:
                pair[i] = known = find(token[i] << 32 | r, -1)
                if known >= 0:
                    heappush(heap, known << 32 | i)
        return [r for r in token if r >= 0]


class Spans(dict):
    """Numbers of strings, given in turn as they are first asked for; -1 for text with white space at an end. Those not
    yet resolved wait in `new`."""

    def __init__(self, new: list[tuple[str, str]], numbers: Iterator[int], prefix: str):
        super().__init__()
        self.new, self.numbers, self.prefix = new, numbers, prefix

    def __missing__(self, text: str) -> int:
        if not text or text[0].isspace() or text[-1].isspace():
            number = -1
        else:
            number = next(self.numbers)
            self.new.append((number, self.prefix + text))
        self[text] = number
        return number


class Encoder:
    """Encodes texts. Text between single spaces is looked up in the cache first: no match of the pattern crosses a
    space that stands between two characters that are no white space, but as its first character; and a match is one
    match when it stands alone, too."""

    def __init__(self, hashed: PerfectHash, pattern: str):
        self.hashed = hashed
        self.merger = Merger(hashed.keys)
        self.pieces = regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.new: list[tuple[int, str]] = []
        numbers = count()
        self.first, self.after_space = Spans(self.new, numbers, ""), Spans(self.new, numbers, " ")
        self.flat, self.starts, self.lengths, self.chars = array("i"), array("q"), array("q"), 0

    def held(self) -> int:
        """Bytes that the cache holds, roughly."""
        return 170 * len(self.starts) + self.chars + 4 * len(self.flat)

    def _number(self, piece: str) -> int | None:
        """The number of a match of the pattern, if it has one."""
        return self.after_space.get(piece[1:]) if piece[0] == " " else self.first.get(piece)

    def merged(self, pieces: list[str]) -> list[list[int]]:
        """The ids of matches of the pattern, without the cache."""
        raw = [p.encode() for p in pieces]
        return [[i] if i >= 0 else self.merger.merge(r) for i, r in zip(self.hashed.find(raw), raw, strict=True)]

    def ids(self, text: str) -> list[int]:
        """The ids of any string, without the cache."""
        return [i for own in self.merged(self.pieces(text)) for i in own]

    def _learn(self) -> None:
        """Resolve what is new: first what is one match, then what is several, which may be among the former."""
        base, new = len(self.starts), self.new
        split = [self.pieces(text) for _, text in new]
        out: list[list[int] | None] = [None] * len(new)
        single = [k for k, own in enumerate(split) if len(own) == 1]
        for k, ids in zip(single, self.merged([new[k][1] for k in single]), strict=True):
            out[k] = ids
        flat, starts, lengths = self.flat, self.starts, self.lengths

        def known(piece: str) -> list[int] | None:
            number = self._number(piece)
            if number is None or number < 0:
                return None
            return out[number - base] if number >= base else flat[starts[number] : starts[number] + lengths[number]]

        more = list({p for own in split if len(own) > 1 for p in own if known(p) is None})
        others = dict(zip(more, self.merged(more), strict=True))
        for k, own in enumerate(split):
            if len(own) > 1:
                out[k] = [i for p in own for i in (others[p] if p in others else known(p))]
        for (_, text), ids in zip(new, out, strict=True):
            starts.append(len(flat))
            lengths.append(len(ids))
            flat.extend(ids)
            self.chars += len(text)
        new.clear()

    def encode(self, texts: list[str | None]) -> pa.Array:
        if self.held() > CACHE:
            self._reset()
        first, find, codes = self.first, self.after_space.__getitem__, []
        for text in texts:
            chunks = (text or "").split(" ")
            own = np.empty(len(chunks), dtype=np.int64)
            own[0] = first[chunks[0]]
            own[1:] = np.fromiter(map(find, chunks[1:]), dtype=np.int64, count=len(chunks) - 1)
            codes.append(own)
        self._learn()
        flat, starts, lengths, parts = np.array(self.flat, dtype=np.int32), np.array(self.starts), np.array(self.lengths), []
        for text, own in zip(texts, codes, strict=True):
            if own.min() < 0:
                parts.append(np.array(self.ids(text or ""), dtype=np.int32))
            else:
                parts.append(gather(flat, starts[own], lengths[own]))
        offsets = np.zeros(len(parts) + 1, dtype=np.int32)
        np.cumsum([len(x) for x in parts], out=offsets[1:])
        values = np.concatenate([*parts, np.empty(0, dtype=np.int32)])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_KEPT: dict[tuple[str, str], Encoder] = {}


def kept_encoder(hashed: PerfectHash, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    key = (hashed.digest, pattern)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(hashed, pattern)
    return _KEPT[key]


def encoding(spark: SparkSession, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> ArrowStep:
    """The step from a text to its ids. The driver reads the rank file; the hash, whose size is that of the vocabulary,
    is broadcast."""
    hashed = spark.sparkContext.broadcast(PerfectHash(load_ranks(ranks_path)))

    def worker() -> Callable[[pa.Array], pa.Array]:
        encoder = kept_encoder(hashed.value, pattern)
        return lambda column: encoder.encode(column.to_pylist())

    return ArrowStep(ids, T.ArrayType(T.IntegerType()), text, worker)


def decoding(spark: SparkSession, ranks_path: str, ids: str = "ids", out: str = "decoded") -> ArrowStep:
    """The step from ids to bytes."""
    keys = load_ranks(ranks_path)
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    known = spark.sparkContext.broadcast((np.frombuffer(b"".join(keys), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths))

    def worker() -> Callable[[pa.Array], pa.Array]:
        values, starts, sizes = known.value

        def run(column: pa.Array) -> pa.Array:
            out = []
            for x in column:
                if not x.is_valid:
                    out.append(None)
                    continue
                own = x.values.to_numpy()
                if len(own) and (own.min() < 0 or own.max() >= len(sizes)):
                    raise ValueError("an id outside the vocabulary")
                out.append(gather(values, starts[own], sizes[own]).tobytes())
            return pa.array(out, type=pa.binary())

        return run

    return ArrowStep(out, T.BinaryType(), ids, worker)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of token ids of each whole text: each match of the pattern is encoded separately, and no
    special token is made. A null or empty text gets an empty array; equal rows stay rows. A column named as `ids` is
    replaced."""
    return add_arrow_columns(docs, encoding(docs.sparkSession, ranks_path, pattern, text, ids))


def decode(tokens: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """tokens with the bytes that each array of ids stands for; null for a null array, no bytes for an empty one. An id
    that is no rank is an error. A column named as `out` is replaced."""
    return add_arrow_columns(tokens, decoding(tokens.sparkSession, ranks_path, ids, out))


def op2_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Every text of documents, encoded and decoded again, as counts and digests. Both steps are one pass of one worker."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = encoding(spark, path, public_tokenizers.PATTERN), decoding(spark, path)
    return add_arrow_columns(docs, *steps, without=("text",)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
