"""The pipeline's stages, each against what its operator decides alone."""

import numpy as np

import __spark_entry__
import corpus_pipeline
from tests.llm import helpers
from tests.llm.test_classifiers import brute_quality, brute_toxicity
from tests.llm.test_duplicates import brute_matches
from verdex.llm import bpe, quality, toxicity
from verdex.llm.queries import labelled


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    columns = docs.columns
    expected = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, small)
        if name == "toxicity":
            model = toxicity.train(labelled(spark, kept, small, "toxic", 3, 1), "text", "label", "doc_id")
            marked = [(r["text"], r["label"]) for r in labelled(spark, kept, small, "toxic", 3, 1).collect()]
            gone = {i for i, (score, _) in brute_toxicity(expected.items(), marked, model).items() if score >= 0.7}
            assert gone
        elif name == "quality":
            model = quality.train(labelled(spark, kept, small, "quality", 4, 2), "text", "label", "doc_id")
            gone = {i for i, t in expected.items() if brute_quality(t, model) < 0.7}
            assert gone
        elif name == "minhash":
            gone = {i for i, (_, _, stays) in helpers.near_duplicates(expected.items(), k=5).items() if not stays}
            assert gone
        elif name == "decontamination":
            gone = {d for d, _ in brute_matches(expected.items(), items)}
            assert gone
        else:
            encoder = bpe.Encoder(bpe.read_ranks(bpe.default_vocabulary()), bpe.default_pattern())
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(expected)
            assert all(np.frombuffer(r["ids"], "<u4").tolist() == encoder.encode(expected[r["doc_id"]] or "") for r in rows)
            break
        expected = {i: t for i, t in expected.items() if i not in gone}
        assert out.columns == columns
        assert {r["doc_id"]: r["text"] for r in out.collect()} == expected
        kept = out


def test_run_and_registration(spark, small):
    out = __spark_entry__.queries()["pipeline"](spark, small)
    assert out.count() > 0 and "n_tokens" in out.columns
    for n in range(1, 14):
        assert any(name.startswith(f"op{n}_") for name in __spark_entry__.queries())


def test_stages_take_odd_tables(spark, small):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "y"), (2, "", "en", "s", 0, "y"), (None, "some words here", None, None, 1, "z"), (5, "long " * 30_000, "en", "s", 2, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    expected = {
        "toxicity": rows,
        "minhash": [r for n, r in enumerate(rows) if n != 2],  # the repeated blank row
        "decontamination": rows,
    }
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, small).collect()
        if name in expected:
            assert sorted(map(tuple, got), key=repr) == sorted(expected[name], key=repr)
        elif name == "quality":
            # Null and empty texts have one score, so all of them stay or none.
            assert len([r for r in got if not r["text"]]) in (0, 3) and {tuple(r) for r in got} <= set(rows)
        else:
            assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in got) == sorted((r[0] or 0, r[1] or "") for r in rows)
            assert all((r["n_tokens"] == 0) == (not r["decoded"]) for r in got)
        assert stage(spark, docs.limit(0), small).count() == 0


def test_copies_are_dropped_row_by_row(spark):
    a, b, c, d = (" ".join(f"{x}{n}" for n in range(30)) for x in "abcd")
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (3, c), (0, c), (None, c), (None, d), (None, d), (7, ""), (7, ""), (7, None), (8, ""), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (1, b), (0, c), (None, d), (7, ""), (7, None), (8, ""), (None, ""), (None, None)], key=repr)
