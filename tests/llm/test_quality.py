import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tasteframe.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


TEXTS = ["", None, " \n ", "a b c a b c", "a a a a a", "x\x0by\x1cz\x85 q", "l\nl\n l\nl ", "é日🙂 ## |a| <b>", "one two", "a b c d " * 4000, "a ba c ab a c", "\n\n\n"]


def test_statistics_equal_brute_force(spark):
    random.seed(3)
    texts = TEXTS + [" ".join(random.choice("abcd") for _ in range(n)) + "\n" for n in range(1, 60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    for r in quality.statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), texts[r.doc_id]


def test_query_equals_brute_force_and_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in quality.op10_quality_rules(spark, sf).collect()}
    assert rows.keys() == docs.keys()
    for k, r in rows.items():
        n, chars, symbols, dup, rep = brute(docs[k])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    labels = [(r.quality, rows[r.doc_id]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows]
    judged = [(q, r.kept) for q, r in labels if not r.base_failed]
    good = [kept for q, kept in judged if q == 1]
    bad = [kept for q, kept in judged if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_no_labels_no_rules(spark):
    docs = spark.createDataFrame([(1, "w " * 60 + "x"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert out[None].base_failed and not out[None].kept and out[1].rule == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_rules_are_ordered_expressions():
    c = quality.Condition("symbol_share", True, 0.25)
    assert str(c) == "symbol_share > 0.25"


def test_grow_and_prune(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), ((F.col("id") % 10 > 6) & (F.col("id") % 7 <= 2)).cast("int").alias("reject"))
    rules = quality.learn(df, features=("a", "b"))
    wrong = df.where((quality.rejected_by(rules) > 0).cast("int") != F.col("reject")).count()
    assert rules and wrong == 0
