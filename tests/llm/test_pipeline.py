"""The pipeline: each stage on awkward rows, and all stages against plain Python counts."""

from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.compare import connect, difference
from tests.conftest import DATA
from tests.llm import cases
from tests.llm.test_ngram_join import shingle_set


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, folder, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = cases.docs(spark)
    out = run(spark, docs, folder)
    if stage < 4:
        assert out.columns == docs.columns and set(out.collect()) <= set(docs.collect())
        assert out.count() > 0
    else:
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert run(spark, cases.empty(spark), folder).count() == 0


def test_whole_pipeline(spark):
    """On the small tables: no copies or near copies stay, clean documents do, packing is full."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).collect()}
    rows = corpus_pipeline.run(spark, DATA).collect()
    left = {r.doc_id for r in rows}
    assert left <= clean
    assert max(Counter(text[i] for i in left).values()) == 1
    sets = {i: shingle_set(text[i]) for i in clean}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    order = sorted(left)
    for k, i in enumerate(order):
        assert not any(alike(sets[i], sets[j]) for j in order[:k] if sets[i] and sets[j])
    for i in clean - left:  # what went has a copy or near copy among the clean ones
        assert any(j != i and (text[j] == text[i] or alike(sets[i], sets[j])) for j in clean)
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("name", ["op4_temperature_mixing", "op8_exact_dedup"])
def test_sql(spark, name):
    sql = contract.oracle_sql()[name]
    assert difference(contract.queries()[name](spark, DATA), connect(DATA), sql) is None


def test_every_operator_is_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and [len(x) for x in corpus_pipeline.STAGES] == [2] * 5


def test_workers_give_back_what_earlier_stages_kept(monkeypatch):
    """Scoring drops encoders that packing left in a worker; packing here keeps few words."""
    from lendlake.llm import encoding, toxicity

    monkeypatch.setitem(encoding.ENCODERS, ("left",), None)
    toxicity._Reader(toxicity.Model(np.zeros(toxicity.BUCKETS), 0.0, 1.0, 0.0, 32))
    assert not encoding.ENCODERS
    asked = {}
    monkeypatch.setattr(corpus_pipeline.packing, "pack_documents", lambda *a, **k: asked.update(k))
    corpus_pipeline.pack(None, None, "")
    assert asked["remembered"] <= 300_000


def test_remembered_words_change_no_pieces(spark):
    from lendlake.llm import packing

    path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
    few, many = (sorted(map(tuple, packing.pieces_of(
        cases.docs(spark), path, 0, **options).collect()), key=str) for options in ({"remembered": 20}, {}))
    assert few == many
