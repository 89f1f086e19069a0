import sys
from pathlib import Path

import public_tokenizers
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tasteframe.llm import quality  # noqa: E402
from tasteframe.llm.common import shared_folder, written  # noqa: E402
from tests.llm import test_jaccard, test_lines, test_packing, test_substrings  # noqa: E402


def test_each_stage_equals_brute_force_on_its_input(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = written(stage(spark, docs, sf), name)
        if name == "packing":
            tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            assert test_packing.check(out.collect(), {k: [*tok.encode(t, add_special_tokens=False).ids, 1] for k, t in before.items()}) == 0
            break
        assert out.columns == columns
        rows = out.collect()
        assert len(rows) == len({r.doc_id for r in rows})
        after = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
            assert after == {k: t for k, t in before.items() if k in kept}
        elif name == "near_duplicates":
            want = test_jaccard.brute(before)
            assert after == {k: t for k, t in before.items() if want[k][1] == k}
        else:
            want = (test_lines if name == "line_dedup" else test_substrings).brute(sorted(before.items()))
            changed = {k: (before[k] if name == "line_dedup" and gone == 0 else kept) for k, (_, gone, kept) in want.items()}
            assert after == {k: t for k, t in changed.items() if t.strip() or not want[k][1]}
            assert all(r.n_chars == len(r.text) for r in rows)
        docs = out
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_odd_rows_and_clashing_columns(spark):
    """Nulls, empty and repeated rows, one id with two texts, and extra columns named as the operators' own."""
    long = " ".join(f"word{i} other{i * 7 % 50}" for i in range(80))
    other = " ".join(f"thing{i * 3 % 90} more{i}" for i in range(80))
    texts = [(1, long), (1, long), (2, long + " end"), (3, other), (4, None), (5, ""), (None, other + " x"), (6, long), (6, "a\nb\nc\n" * 30 + " ".join(f"q{i}" for i in range(60))), (7, "few words")]
    rows = [(k, t, "en", "s", len(t or ""), 7, 8, 9, "k", 1, "f") for k, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_removed int, n_words int, n_lines int, key_ string, version_ int, first_ string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(folder := f"{shared_folder(spark)}/odd/labels.parquet")
    sf = folder.rsplit("/", 1)[0]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, sf)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            got = out.collect()
            assert all((r.n_removed, r.n_words, r.n_lines, r.key_, r.version_, r.first_) == (7, 8, 9, "k", 1, "f") for r in got)
            if own is docs and name == "quality_rules":
                assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "6", "None"]
            if own is docs and name == "near_duplicates":
                assert sorted((r.doc_id, r.text or "") for r in got) == sorted((k, t or "") for k, t in {(1, long), (3, other), (4, None), (5, ""), texts[8], (7, "few words")})
            if own is docs and name == "substring_dedup":  # what repeats the first row goes whole; an id's own rows do not repeat one another
                assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "2", "3", "4", "5", "6", "7", "None"])
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).selectExpr("sum(length)").first()[0] > len(texts)
