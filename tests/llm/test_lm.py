import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tasteframe.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(s, prob):
    if not s:
        return 1.0
    return sum(p * brute(s[len(x):], prob) for x, p in prob.items() if s.startswith(x))


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", *(f"<0x{i:02X}>" for i in range(256))]
    logs = np.log(np.random.default_rng(0).dirichlet(np.ones(len(pieces) + 1)))
    lattice = lm.Lattice(pieces, logs)
    prob = {p: math.exp(x) for p, x in zip(pieces, logs, strict=False) if not p.startswith("<0x")}
    prob["é"] = math.exp(sum(logs[pieces.index(f"<0x{b:02X}>")] for b in "é".encode()))
    words = ["a", "ab", "abab", "babaab", "é", "aéb", "ab" * 30]
    got, expected = lattice.score(words, np.ones(len(words)))
    for w, x in zip(words[:-1], got, strict=False):
        assert math.isclose(math.exp(x), brute("▁" + w, prob), rel_tol=1e-9)
    assert np.isfinite(got).all()
    # each segmentation covers the word: expected characters equal the characters there are
    covered = sum(e * len(p) for p, e in zip(pieces, expected, strict=False) if not p.startswith("<0x"))
    assert math.isclose(covered, sum(len(w) + 1 for w in words) - 2, rel_tol=1e-9)
    assert np.allclose(got, lattice.score(words)[0])


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    low = {k: re.sub("[A-Z]", lambda m: m.group().lower(), t) for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
    count = Counter(w for k, t in low.items() if not held[k] for w in [*WORD.findall(t), None])
    n, v = sum(count.values()), len(count)
    rows = lm.op3_lattice_scores(spark, sf).collect()
    assert len(rows) == len(docs)
    import public_tokenizers

    pieces = lm.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    counts = spark.createDataFrame([(w.encode() if w else lm.END, c, c) for w, c in count.items()], "word binary, n long, n_all long")
    first = lm.Lattice(pieces, lm.estimate(counts, pieces, rounds=0))
    lattice = lm.Lattice(pieces, lm.estimate(counts, pieces))
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = once / (once + 2 * twice)

    def log10(token, by):
        pieces_alone = by.end if token is None else by.score([token])[0][0]
        return math.log10(max(count[token] - d, 0) * (count[token] > 0) / n + d * v / n * math.exp(pieces_alone))

    unseen = 0
    for r in rows:
        tokens = [*WORD.findall(low[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(tokens), sum(count[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        if r.doc_id % 10 == 0 and len(tokens) < 3000:
            assert math.isclose(r.score, sum(log10(t, lattice) for t in tokens), rel_tol=1e-6)
        if r.held_out:
            new = [t for t in tokens if t is not None and not count[t]]
            unseen += lattice.score(new)[0].sum() - first.score(new)[0].sum() if new else 0
    assert unseen > 0  # what was estimated from the training documents explains unseen words of the others better


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "A a é", 1), (2, "", 1), (3, "x" * 5000, 1)], "doc_id long, text string, word int")
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = lm.score_documents(df, path, "doc_id = 3").collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 1, 2, 4] and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm.score_documents(df.limit(0), path, "false").count() == 0


def test_shuffled_and_joined_inputs_keep_all_rows(spark):
    """Row numbers must not be made twice: inputs whose partitions differ from scan to scan."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path, held = public_tokenizers.path("piece_bpe_32k.model"), "doc_id % 7 = 2"
    want = {r.doc_id: r.n_tokens for r in lm.score_documents(docs, path, held).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    for own in (docs.repartition("doc_id"), docs.join(labels, "doc_id", "left")):
        got = lm.score_documents(own, path, held).collect()
        assert len(got) == len(want) and {r.doc_id: r.n_tokens for r in got} == want


def test_equal_texts_have_equal_scores(spark):
    """To the last bit, wherever they stand: frequent words are added up in a task, the others after a shuffle."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    copies = docs.selectExpr("doc_id + 10000000 AS doc_id", "text").repartition(5, "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = lm.score_documents(docs.union(copies), path, "doc_id % 7 = 2", most_frequent=500).collect()
    scores = {r.doc_id: (r.base_score, r.score, r.n_known) for r in rows}
    own = [k for k in scores if k < 10000000]
    assert own and all(scores[k] == scores[k + 10000000] for k in own)


def test_beginnings_are_found_by_their_top_bits():
    rng = random.Random(11)
    pieces = sorted({"".join(rng.choices("abcdé▁", k=rng.randrange(1, 9))) for _ in range(3000)}) + [f"<0x{b:02X}>" for b in range(256)]
    lattice = lm.Lattice(pieces, np.log(np.full(len(pieces) + 1, 1 / (len(pieces) + 1))))
    beginnings = {p[:k] for p in pieces[:-256] for k in range(1, len(p) + 1)}
    others = {"".join(rng.choices("abcdéxyz▁", k=rng.randrange(1, 12))) for _ in range(3000)} - beginnings
    asked = [*sorted(beginnings), *sorted(others), ""]
    found, at = lattice._look_up(np.array([lattice._hash(p) for p in asked], dtype=np.uint64))
    assert found.tolist() == [p in beginnings for p in asked]
    assert lattice.piece[at[found]].tolist() == [lattice.number.get(p, -1) for p in asked if p in beginnings]
    # small batches are scored together, and every word once
    batch = pa.RecordBatch.from_arrays([pa.array(range(lm.AT_ONCE // 5))], names=["word"])
    assert [t.num_rows for t in lm.merged(iter([batch] * 7))] == [lm.AT_ONCE, 2 * (lm.AT_ONCE // 5)]
    assert list(lm.merged(iter([]))) == []
