import hashlib
import random

from tasteframe.llm import lines

SPACE = " \t\n\x0b\x0c\r"


def brute(docs, run=3):
    seen, out = set(), {}
    for key, text in docs:
        every = (text or "").split("\n")
        own = [i for i, x in enumerate(every) if x.strip(SPACE)]
        gone = set()
        for i in range(len(own) - run + 1):
            w = tuple(every[j].strip(SPACE) for j in own[i : i + run])
            if w in seen:
                gone.update(own[i : i + run])
            seen.add(w)
        out[key] = (len(own), len(gone), "\n".join(x for i, x in enumerate(every) if i not in gone))
    return out


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    want = brute(sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    rows = lines.op1_repeated_lines(spark, sf).collect()
    assert len(rows) == len(want) and sum(r.n_removed for r in rows) > 0
    for r in rows:
        n, gone, kept = want[r.doc_id]
        assert (r.n_lines, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_random_runs_and_odd_rows(spark):
    random.seed(4)
    pool = [f"line {i}" for i in range(12)]
    texts = {k: "\n".join(random.choice([random.choice(pool), random.choice(pool), "", f"own {random.random()}", " line 1\t"]) for _ in range(random.randint(0, 40))) for k in range(60)}
    texts |= {100: None, 101: "", 102: "\n\n", 103: "a\n" * 300, 104: "é\x0bx\n" * 2 + "é\x0bx"}
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in texts.items()], "doc_id long, text string, n_lines int, starts_ int")
    want = brute(sorted(texts.items()))
    for r in lines.cut_repeated_lines(df).collect():
        assert (r.n_lines, r.n_removed, r.kept) == want[r.doc_id]
    assert lines.cut_repeated_lines(df.limit(0)).count() == 0


def test_positions_are_the_selected_lines(spark):
    """A row for each distinct least line, however many windows it stands for; few windows are left to be met by their lines."""
    from tasteframe.llm.windows import minimizers, word_hashes

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    count, own = {}, {}
    for r in docs.collect():
        x = word_hashes(lines.Lines.split((r.text or "").encode()))
        h, at = minimizers(x, 3, 1)
        own[r.doc_id] = dict(zip(at.tolist(), h.tolist(), strict=True))
        for v in own[r.doc_id].values():
            count[v] = count.get(v, 0) + 1
    found = lines.positions(docs, 3, "doc_id", "text").cache()
    got = {(r.key, r.pos) for r in found.where("pos is not null").collect()}
    repeated = {(k, p) for k, places in own.items() for p, v in places.items() if count[v] > 1}
    assert len(got) == found.where("pos is not null").count() and got <= repeated
    windows = found.selectExpr("explode(starts)").count()
    assert len(got) < windows
    judged = lines.extended(found, 3)
    assert judged.where("reached").count() > judged.where("not reached").count()


def test_extension_decides(spark, monkeypatch):
    """Taken as far as it could go, it removes lines that only stand beside the same ones."""
    texts = ["a\nb\nc\nd", "x\nb\nc\nd", *(f"y{i}\nb\nc\nz{i}" for i in range(9)), "q\nx\nb\nc\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(list(enumerate(texts)))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.cut_repeated_lines(df).collect()} == want
    monkeypatch.setattr(lines, "equal_lines", lambda x, y: lines.F.size(x).cast("int"))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.cut_repeated_lines(df).collect()} != want


def test_common_line_in_many_contexts_and_keys_that_repeat(spark):
    random.seed(5)
    texts = [(k % 70 if k % 11 else None, "\n".join(random.choice(["common", "menu", "foot", "top", f"own {random.randint(0, 4)}"]) for _ in range(random.randint(2, 12)))) for k in range(70)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = brute([t for t in texts if t[0] is not None])
    got = lines.cut_repeated_lines(df).collect()
    assert len(got) == len(texts)
    assert all((r.n_lines, r.n_removed, r.kept) == want[r.doc_id] for r in got if r.doc_id is not None)
    twice = df.where("doc_id is not null").limit(20).withColumn("text", lines.F.lit("one\ntwo\nthree"))
    twice = twice.union(twice)
    first = twice.agg({"doc_id": "min"}).first()[0]
    assert all(r.n_removed == (0 if r.doc_id == first else 3) for r in lines.cut_repeated_lines(twice).collect())
