"""The pipeline's stages on awkward documents: columns kept, decisions in effect."""

import pytest

import corpus_pipeline as pipeline
from panelwright.llm import pii
from tests.llm.helpers import SCHEMA, TEXTS, documents


@pytest.fixture(autouse=True)
def untrained(monkeypatch):
    """The stages' way is tested here, with the patterns' spans; the trained network has its tests with the operators."""
    monkeypatch.setattr(pii, "train_pii", lambda: pii.PiiModel(pii.PiiSettings()))


def test_stages(spark):
    docs = documents(spark, TEXTS).select("doc_id", "text", "lang", "source", "n_chars")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "pii", "mixing", "packing"]
    stage = dict(pipeline.STAGES)
    known = stage["language_id"](spark, docs, "")
    assert known.columns == docs.columns and known.where("doc_id IN (4, 5, 6, 12)").count() == 0
    single = stage["near_duplicates"](spark, docs, "")
    ids = [r["doc_id"] for r in single.select("doc_id").collect()]
    assert single.columns == docs.columns and not {2, 3, 10} & set(ids) and {1, 4, 5, 9, None} <= set(ids) and ids.count(13) == 1
    assert stage["pii"](spark, docs, "").where("text LIKE '%<EMAIL>%'").count() == 1
    assert stage["mixing"](spark, docs, "").columns == docs.columns
    assert stage["packing"](spark, docs, "").count() >= len(TEXTS)
    none = spark.createDataFrame([], SCHEMA).select(*docs.columns)
    for _, f in pipeline.STAGES:
        assert f(spark, none, "").count() == 0


def test_stages_leave_unknown_columns_alone(spark):
    """Columns with names that operators use themselves come through the stages unchanged."""
    docs = documents(spark)
    for name, f in pipeline.STAGES[:4]:
        out = f(spark, docs.fillna("own", ["score", "n", "rep", "cluster", "mix_tokens", "key", "grp"]), "")
        assert out.columns == docs.columns and out.count() > 0
        assert out.where("mix_tokens <> 'own' OR rep <> 'own' OR n <> 'own' OR grp <> 'own'").count() == 0, name


def test_different_texts_under_one_id_are_judged_each(spark):
    words = [f"word{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(reversed(words))), (2, " ".join(words) + " end"), (2, "else " * 30), (None, "nobody"), (None, "nobody")], "doc_id long, text string")
    out = dict(pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:6]) for r in out) == [(0, "nobody"), (0, "nobody"), (1, "word0 "), (1, "word19"), (2, "else e")]


def test_run_reads_what_it_wrote(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0 and out.count() > 0
