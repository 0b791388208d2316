"""Nearest neighbours against brute force; language and toxicity on held-out rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlake.llm import labels, language, nearest, shared, toxicity
from lendlake.llm.nearest import Search
from lendlake.llm.shared import read
from tests.llm import cases

DATA = "/root/testdata/sf0.01"


def exact(rows, queries, k=10):
    out = {}
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=np.float64)
    for q in queries:
        own = vectors[ids == q][0]
        d = np.sqrt(((vectors - own) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)


def searched(df, search=Search(), every=10):
    out = {}
    for r in nearest.nearest_neighbours(df, F.col("vec_id") % every == 0, search).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("search", [Search(), Search(part_rows=64, sample_rows=500)])
def test_recall_and_scores(spark, search):
    random = np.random.default_rng(3)
    rows = [(i, random.standard_normal(24).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, [x + 0.01 * i for x in rows[i % 5][1]]) for i in range(60)]
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    got, want = searched(vectors(spark, rows), search), exact(rows, [i for i, _ in rows if i % 10 == 0])
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert np.mean(hits) / 10 >= 0.9
    where = dict(rows)
    for q, best in got.items():
        assert best == sorted(best, key=lambda x: (x[1], x[0])) and len(best) == 10
        for i, score in best:
            own = np.array(where[q], np.float64) - np.array(where[i], np.float64)
            assert score == pytest.approx(math.sqrt((own ** 2).sum()), abs=1e-12)


def test_copies_and_ties_go_by_id(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 5.0])
                                                              for i in range(30)]
    got = searched(vectors(spark, rows), Search(part_rows=50), every=100)
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[200] == [(i, 0.0) for i in range(10)]
    assert got[1000] == [(i, 0.0) for i in range(1001, 1011)]


def test_unusable_vectors_and_few_rows(spark):
    good = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (10, [3.0, 4.0])]
    bad = [(2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]),
           (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (20, []), (30, None)]
    df = vectors(spark, good + bad).withColumns({"cell": F.lit(1), "bound": F.lit(1), "part": F.lit(1)})
    assert searched(df) == exact(good, [0, 10])
    assert searched(vectors(spark, good + [good[0]]))[10] == [(0, math.sqrt(20)), (0, math.sqrt(20)),
                                                             (1, math.sqrt(18))][::-1][:1] + [
        (0, math.sqrt(20)), (0, math.sqrt(20))]
    assert searched(vectors(spark, bad)) == {} and searched(vectors(spark, [])) == {}


def test_chi_square_quantiles():
    for p, freedom, value in ((0.95, 2, 5.991465), (0.95, 8, 15.50731), (0.99, 6, 16.81189)):
        assert nearest.chi_square_quantile(p, freedom) == pytest.approx(value, abs=1e-5)


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, DATA, "documents")


def test_language_of_held_out_documents(spark, documents):
    held = labels.held_out(3, 1)
    model = language.train(documents, ~held)
    got = language.identify(documents.where(held), model, reject=False)
    right = got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")),
                       F.min("lang_score"), F.max("lang_score")).first()
    assert right[0] >= 0.97 and 0 <= right[1] and right[2] <= 1
    assert len(model.owner) > len(model.languages) == 4  # several centroids each
    assert (np.bincount(model.owner) == 4).all()


def test_language_rejects_what_is_far(spark, documents):
    model = language.train(documents, F.lit(True))
    odd = spark.createDataFrame([(1, "ωωω ψψψ χχχ φφφ " * 9), (2, "1234 !"), (3, None), (4, "")],
                                "doc_id bigint, text string")
    got = {r.doc_id: r for r in language.identify(cases.clashing(odd), model).collect()}
    assert got[1].lang_pred == "und" and got[1].lang_rejected
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (2, 3, 4))
    forced = language.identify(odd, model, reject=False).where("doc_id = 1").first()
    assert forced.lang_pred in model.languages
    kept = language.identify(documents, model).where("lang_rejected").count()
    assert kept <= 30


def test_samples_of_copies(spark):
    """30,000 copies of one text neither leave a class without a sample nor fill the driver."""
    german = "der wald und die heide liegen still im nebel über dem tal"
    english = [f"the {w} and the {v} were in the house of the king" for w in ("cat", "dog", "owl")
               for v in ("hen", "ram", "elk")]
    df = spark.range(30_000).select(F.lit(german).alias("text"), F.lit("de").alias("lang")).unionByName(
        spark.createDataFrame([(x, "en") for x in english * 300], "text string, lang string"))
    drawn = shared.some_of_each(df, "lang", 600, 1)
    assert dict(drawn.groupBy("lang").count().collect()) == {"de": 600, "en": 600}
    assert drawn.exceptAll(shared.some_of_each(df.repartition(5), "lang", 600, 1)).isEmpty()
    model = language.train(df, F.lit(True))
    got = language.identify(spark.createDataFrame([(german,), (english[0],)], "text string"), model,
                            reject=False).collect()
    assert {r.text: r.lang_pred for r in got} == {german: "de", english[0]: "en"}
    few = shared.some_of_each(df.limit(7), "lang", 600, 1)
    assert few.count() == 7


def test_language_without_anything(spark):
    model = language.train(cases.empty(spark), F.lit(True))
    assert {r.lang_pred for r in language.identify(cases.docs(spark), model).collect()} == {"und"}
    assert language.identify(cases.empty(spark), model).count() == 0
    some = language.train(cases.docs(spark), F.lit(True))  # null languages and texts teach nothing
    assert some.languages == ["de", "en"]


def test_long_texts_are_counted_whole():
    text = ("abc é " * 400_000).encode()
    pieces, count = language.counts([text])[0], language.counts([b"abc \xc3\xa9 "])[0]
    assert pieces.sum() == pytest.approx(400_000 * 14, rel=1e-3) and (count > 0).sum() >= 8


def test_toxicity_of_held_out_documents(spark):
    docs, known = read(spark, "/root/testdata/sf0.1", "documents"), read(
        spark, "/root/testdata/sf0.1", "labels")
    model = labels.train_toxicity(docs, known)
    scored = toxicity.score(labels.with_labels(docs, known, "toxic").where(labels.held_out(5, 0)), model)
    rows = scored.where("toxic is not null").select("toxic", "toxicity").collect()
    toxic = [r.toxicity for r in rows if r.toxic == 1]
    clean = [r.toxicity for r in rows if r.toxic == 0]
    assert np.mean([x >= 0.5 for x in toxic]) >= 0.75 and np.mean([x >= 0.5 for x in clean]) <= 0.05
    ranked = np.mean([[a > b for b in clean] for a in toxic])  # area under the curve
    assert ranked >= 0.93


def test_misspellings_score_like_the_word(spark):
    base = [cases.prose(i, 80) for i in range(400)]
    rows = [(i, t + (" abominable fool" if i % 4 == 0 else ""), int(i % 4 == 0))
            for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, F.lit(True), F.col("toxic"))
    new = spark.createDataFrame(
        [(1, base[1]), (2, base[1] + " abominabel"), (3, None), (4, ""), (5, "..."),
         (6, " ".join(base[1:100]) + " abominable fool")], "doc_id bigint, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.score(cases.clashing(new), model).collect()}
    assert got[1] < 0.5 and got[2] > got[1] and got[6] >= 0.5
    assert got[3] == got[4] == got[5] < 0.5 and all(0 <= x <= 1 for x in got.values())


def test_every_passage_of_a_long_text_is_read(spark):
    """The toxic words are in one of 100 passages, at any place; each is met in training."""
    def text(i):
        words = cases.prose(i, 3200).split(" ")
        if i % 2:
            at = i * 53 % 3190
            words[at:at + 8] = ["abominable", "fool"] * 4
        return " ".join(words)
    df = spark.createDataFrame([(i, text(i), i % 2) for i in range(40)], "doc_id bigint, text string, toxic int")
    rows = df.selectExpr("xxhash64(text) tie", "toxic label", "text")
    told = np.zeros(toxicity.BUCKETS)
    told[toxicity.subwords(["abominable", "fool"])[0]] = 1.0
    found = toxicity._chosen(rows, toxicity.Model(told, 0.5, 1.0, 0.0, 32), 1, 3)
    assert all(("abominable" in x.top) == (x.label == 1) for x in found.itertuples()) and len(found) == 40
    reader = toxicity._Reader(toxicity.Model(told, 0.5, 1.0, 0.0, 32))
    assert sorted(found["logit"]) == pytest.approx(sorted(reader.logits([r.text for r in df.collect()])))


def test_toxicity_without_both_classes(spark):
    df = spark.createDataFrame([(1, "some words", 0), (2, None, 1), (3, "others", None)],
                               "doc_id bigint, text string, toxic int")
    model = toxicity.train(df, F.lit(True), F.col("toxic"))
    assert all(r.toxicity < 0.5 for r in toxicity.score(df, model).collect())
    none = toxicity.train(df.limit(0), F.lit(True), F.col("toxic"))
    assert toxicity.score(cases.empty(spark), none).count() == 0


def test_labels_join(spark):
    docs = cases.clashing(cases.docs(spark))
    known = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (None, 0, 1), (8, 1, 0)],
                                  "doc_id bigint, quality int, toxic int")
    got = labels.with_labels(docs, known, "y")
    assert Counter((r.doc_id, r.y) for r in got.collect())[1, 1] == 1 and got.count() == docs.count()
