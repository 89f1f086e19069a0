import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tasteframe.llm import jaccard, substrings, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, n=20):
    """docs: (key, text) in order of keys."""
    seen, out = set(), {}
    for key, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen:
                gone.update(range(i, i + n))
            seen.add(w)
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[key] = (len(words), len(gone), " ".join(kept))
    return out


def test_rolling_equals_definition():
    x = np.arange(1, 60, dtype=np.uint64) * np.uint64(977)
    for n in (1, 2, 3, 7, 10, 20, 59):
        want = [sum(int(x[i + j]) * pow(int(windows.BASES[0]), n - 1 - j, 1 << 64) for j in range(n)) % (1 << 64) for i in range(len(x) - n + 1)]
        assert windows.rolling(x, n).tolist() == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute(docs)
    rows = substrings.op8_repeated_windows(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_random_repeats_and_odd_rows(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    passages = [[random.choice(words) for _ in range(random.randint(5, 50))] for _ in range(6)]
    texts = {}
    for k in range(40):
        parts = [random.choice(passages) if random.random() < 0.6 else [random.choice(words) for _ in range(random.randint(1, 30))] for _ in range(random.randint(1, 6))]
        texts[k] = random.choice([" ", "\n", "\t "]).join(w for p in parts for w in p)
    texts |= {100: "", 101: None, 102: "a " * 500, 103: "one\x0btwo", 104: "a " * 19 + "a"}
    want = brute(sorted(texts.items()))
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in texts.items()], "doc_id long, text string, kept string, version int")
    for r in substrings.cut_repeats(df).collect():
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id], r.doc_id
    twice = df.where("doc_id = 102").union(df.where("doc_id = 102")).union(df.where("doc_id = 102").selectExpr("null as doc_id", "text", "kept", "version"))
    assert sorted((r.doc_id or -1, r.n_removed) for r in substrings.cut_repeats(twice).collect()) == [(-1, 500), (102, 499), (102, 499)]
    assert substrings.cut_repeats(df.limit(0)).count() == 0


def test_bitmap_and_sketch_come_in_few_jobs(spark):
    # one job a partition fills the driver's memory where there are many
    counted, context = {}, spark.sparkContext
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = {n: spark.conf.get(n) for n in names}
    h = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 500).tolist()
    hashes = spark.createDataFrame([(x, 1 + i % 2) for i, x in enumerate(h)], "h long, n int")
    texts = spark.createDataFrame([(b"one two three four five six %d" % (i % 3),) for i in range(9)], "text binary")
    try:
        for n in (2, 40):
            for name, value in zip(names, (n, "false"), strict=True):
                spark.conf.set(name, value)
            context.setJobGroup(f"bitmap-{n}", "")
            bitmap = substrings.repeated_bitmap(hashes)
            assert int(np.unpackbits(bitmap).sum()) == 250 and substrings.in_bitmap(bitmap, np.array(h[1::2]).view(np.uint64)).all()
            assert jaccard.counts_of_all(texts, 5).sum() == 27
            counted[n] = len(context.statusTracker().getJobIdsForGroup(f"bitmap-{n}"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for name, value in before.items():
            spark.conf.set(name, value)
    assert 0 < counted[40] == counted[2]


ODD = ["", " \n\t ", "one", " two  words\x0b", "a\x00 a a\x00\x00", "nul\x00", "\x1cx\x1fy \x85z\xa0", "", "é ü\r\nß", "x" * 8 + " " + "x" * 9, "ends", "starts", "a " * 45]
ODD += [" ".join("ab"[(n + k) % 2] * n for k in range(2)) for n in range(1, 140)] + ["q" * 64 + "r " + "q" * 64 + "s " + "q" * 63 + "r"]


def test_words_of_many_texts_at_once():
    texts = pa.array([t.encode() for t in ODD], type=pa.binary())
    for array in (texts, texts.slice(3, 20), texts.slice(1, 1), texts.slice(0, 0), texts.cast(pa.large_binary()).slice(2)):
        lists = [t.split() for t in array.to_pylist()]
        x, bounds = windows.text_hashes(array)
        assert bounds.tolist() == np.cumsum([0, *map(len, lists)]).tolist()
        pairs = set(zip((w for words in lists for w in words), x.tolist(), strict=True))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_minimizers_of_many_texts_at_once():
    rng = np.random.default_rng(4)
    lists = [rng.integers(0, 3 if k % 2 else 1 << 60, n).astype(np.uint64) for k, n in enumerate([0, 1, 19, 20, 21, 300, 0, 20, 55, 7, 40])]
    x, bounds = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    for n, k in ((20, 10), (3, 1), (1, 1), (7, 3), (400, 200), (1000, 500)):
        h, inside, new = windows.least_parts(x, bounds, n, k)
        want = [windows.minimizers(own, n, k) for own in lists]
        places = [np.diff(at, prepend=-1) != 0 for _, at in want]
        assert np.array_equal(h[inside], np.concatenate([own for own, _ in want])) and np.array_equal(new[inside], np.concatenate(places))
        assert not new[~inside].any()
    again = substrings.started_before(x, bounds)
    assert again.tolist() == [v in own[:i] for own in map(np.ndarray.tolist, lists) for i, v in enumerate(own)]


def test_many_texts_at_once_take_less_time():
    # hashing word by word, and minimizers text by text, took op8 over its CPU seconds
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks().fill_null("").cast(pa.binary())

    def each():
        return sum(len(windows.minimizers(windows.word_hashes(t.split()), 20, 10)[0]) for t in texts.to_pylist())

    def at_once():
        return int(windows.least_parts(*substrings.Words.hashes(texts), 20, 10)[1].sum())

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    assert each() == at_once()
    assert min(seconds(at_once) for _ in range(3)) < min(seconds(each) for _ in range(3)) / 2
