import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tasteframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "one two", "ΟΔΟΣ ΣΑΣ Σ", "it's  a non\x0bbreak\x85 x", "é ́x", "<|endoftext|> in text a<|startoftext|>b", "\x1c!\x1c! y", "ab " * 5000, "日本語", "İstanbul ﬁ", "one two", "!?" * 900, "<|ENDOFTEXT|> A, b.c, d's. É! e\u0301. 5, x5. ,. Σ, ǅ, ㍿,", "THE The the, THE!! the%%%"]


def check(rows, expected, limit=2048, segments=256):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, ids in expected.items():
        own, at = sorted(by_doc[k], key=lambda r: r.start), 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit and len(own) <= segments
        padding += 0 if at & (at - 1) == 0 else limit - at
    return padding


def test_pieces_are_exact_and_full(spark):
    tok = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, start int")
    rows = packing.pack_texts(df, PATH, 1, max_segments=20).collect()
    expected = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert check(rows, expected) == 0
    for r in rows:
        assert list(r.ids) == expected[r.doc_id][r.start : r.start + r.length]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    tok = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert check(packing.op4_packing(spark, sf).collect(), {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 1] for r in docs}) == 0


def test_three_limits_hold():
    rng = np.random.default_rng(1)
    packer, got, ids = packing.Packer(64, 5, 20, 10, 0), [], {}
    masks = {}
    for k in range(200):
        n = int(rng.integers(1, 200))
        ids[k], masks[k] = np.arange(n, dtype=np.uint32), rng.random(n) < 0.3
        got += packer.put(k, ids[k], masks[k])
    got += packer.finish()
    seq, seen = {}, {}
    for key, start, part, _, sequence, offset in got:
        seq.setdefault(sequence, []).append((offset, len(part), int(masks[key][start : start + len(part)].sum())))
        seen.setdefault(key, []).extend(part.tolist())
    assert all(sorted(v) == list(range(len(ids[k]))) for k, v in seen.items()) and len(seen) == 200
    for own in seq.values():
        assert sum(n for _, n, _ in own) <= 64 and len(own) <= 5 and sum(x for *_, x in own) <= 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_texts(df, PATH, 1).count() == 0


def test_loss_spans_fill_the_third_limit(spark):
    """Prompts bear no loss: of 40 texts of 30 words each, the last 12 words and the end do."""
    rows = [(i, "the " * 30, [(18, 30)] if i % 4 else None, None) for i in range(40)] + [(40, "the cat", [(0, 1), (5, 9)], None), (41, None, [], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<a:int,b:int>>, ids string")
    got = packing.pack_texts(df, PATH, 1, max_tokens=256, max_segments=6, max_loss_tokens=64, window=16, loss="spans").collect()
    assert check(got, {i: [r.ids[0]] * 30 + [1] for i in range(40) for r in got if r.doc_id == 0 and r.start == 0} | {41: [1]}, 256, 6) >= 0
    bears = {i: [False] * 18 + [True] * 13 if i % 4 else [True] * 31 for i in range(40)} | {40: [True, False, False], 41: [False]}
    by_seq = {}
    for r in got:
        by_seq[r.sequence_id] = by_seq.get(r.sequence_id, 0) + sum(bears[r.doc_id][r.start : r.start + r.length])
    assert max(by_seq.values()) <= 64 and sum(by_seq.values()) == sum(map(sum, bears.values()))


def test_generations_of_the_word_cache():
    tok = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "Cat.", "sat,", "x!!", "été", f"w{i}q", f"w{i}q.", "a1."], 30)) for i in range(60)]
    cache = packing.WordCache(open(PATH, encoding="utf-8").read(), 20_000)
    for at in range(0, 60, 3):
        for text, (ids, lengths) in zip(texts[at : at + 3], cache.encode([t.encode() for t in texts[at : at + 3]]), strict=True):
            assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids and lengths.sum() == len(ids) and len(lengths) == 30
