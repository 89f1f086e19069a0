import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tasteframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, " ", "a", "  two  spaces ", "line\n\n next\n", "it's we're I'll 's", "x" * 3000, "日本語 テキスト ééé", "tab\tand\x0bvt\x85nel　wide  em",
         "12345 67,89!? #*$", "\x1c\x1f a\x1c b", " lead", "trail ", "<|endoftext|> as text", "word\n next", "a \n b", "ab " * 2000, "🙂🙂 🙃"]


def test_equals_library_and_round_trips(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or ""), r.text
        assert bytes(r.decoded) == (r.text or "").encode()


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op2_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(1000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slots) == list(range(1000)) and h.find(keys) == list(range(1000)) and h.find([b"no"]) == [-1] and h.find([]) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH, public_tokenizers.PATTERN).count() == 0


def test_cache_starts_anew(library, monkeypatch):
    """Pieces of new chunks that are chunks themselves, in one slice and over slices, with a cache that is always full."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n" + rng.choice(words), "!!", "'s"]) for _ in range(80)) for _ in range(60)]
    for most in (0, 1 << 30):
        monkeypatch.setattr(bpe, "CACHE", most)
        encoder = bpe.Encoder(bpe.PerfectHash(bpe.load_ranks(PATH)), public_tokenizers.PATTERN)
        for at in range(0, 60, 7):
            assert encoder.encode(texts[at : at + 7]).to_pylist() == [library.encode_ordinary(t) for t in texts[at : at + 7]]
