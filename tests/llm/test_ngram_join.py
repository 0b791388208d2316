"""The similarity join and components against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from lendlake.llm import components, ngram_join
from lendlake.llm.ngram_join import Join
from tests.llm import cases

WORD = re.compile("[a-z0-9\u0080-\U0010ffff]+")


def shingle_set(text, n=5):
    words = WORD.findall((text or "").lower())
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def by_hand(rows, threshold=0.8):
    """(id, class, links) of every row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and
              len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min(root[i], *(root[j] for j in links[i])) if links[i] else root[i]
                for i in range(len(rows))]
    least = {}
    for i, r in enumerate(root):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == r and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    return Counter((rows[i][0], least[i], len(links[i])) for i in range(len(rows)))


def found(spark, rows, join=Join()):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return Counter(map(tuple, ngram_join.similar_documents(df, join).collect()))


def edited(seed, n, at):
    words = cases.prose(seed, n).split(" ")
    for i in at:
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def corpus():
    rows, k = [], 0
    for seed in range(12):  # near copies at several distances, around the threshold too
        for edits in ([], [10], [10, 40], [5, 25, 45, 65], [80], list(range(0, 90, 9))):
            rows.append((k, edited(seed, 100, edits)))
            k += 1
    passage = cases.prose(77, 60)
    rows += [(k + i, f"{cases.prose(200 + i, 40)} {passage}") for i in range(60)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus()
    assert found(spark, rows) == by_hand(rows)


def test_small_buckets_and_blocks(spark):
    """A group far above the bucket limit is compared in blocks, paths are split many times."""
    rows = corpus() + [(5000 + i, edited(500, 150, [i])) for i in range(70)]
    assert found(spark, rows, Join(brute_force=8)) == by_hand(rows)


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, []) == Counter()
    assert found(spark, [(1, None), (2, ""), (3, "...")]) == by_hand([(1, None), (2, ""), (3, "...")])


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_other_thresholds(spark, threshold):
    rows = corpus()[:60]
    assert found(spark, rows, Join(threshold=threshold, candidate=threshold - 0.18)) == by_hand(
        rows, threshold)


def test_one_of_each_class_keeps_clean_documents(spark):
    docs = cases.clashing(cases.docs(spark))
    left = ngram_join.one_of_each_class(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids == Counter([1, 4, 5, 6, None, None, 8, 8, 9, 11, 13, 14, 15])


def test_shingles_do_not_depend_on_the_batch():
    texts = [t.lower().encode() for _, t in corpus()] + [b"", b"one two", b"a b c d e f " * 9]
    values, bounds = ngram_join.shingles(texts, 5)
    for i, t in enumerate(texts):
        alone, _ = ngram_join.shingles([t], 5)
        assert (values[bounds[i]:bounds[i + 1]] == alone).all()
        assert len(alone) == len(shingle_set(t.decode()))


def test_signatures_estimate_jaccard():
    texts = [edited(1, 400, []).encode(), edited(1, 400, range(0, 60, 10)).encode()]
    values, bounds = ngram_join.shingles(texts, 5)
    sig = ngram_join.signatures(values, bounds)
    a, b = (shingle_set(t.decode()) for t in texts)
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.12


def test_components_of_chains_stars_and_random_links(spark):
    random = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)]
    pairs += [tuple(map(int, x)) for x in random.integers(1000, 1100, (60, 2))]
    df = spark.createDataFrame(pairs, "node bigint, to bigint")
    got = {r.node: r.root for r in components.connected(df).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
    assert components.connected(df.limit(0)).count() == 0


def test_exchanges_run_once(spark, monkeypatch):
    """Partition counts are asked of files, not of frames behind an exchange, which would run it;
    sets are not stored beside their exchange."""
    plans, purposes = [], []

    def asked(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return 4

    def kept(df, purpose, **options):
        purposes.append(purpose)
        return stored(df, purpose, **options)

    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "spread", asked)
    monkeypatch.setattr(ngram_join, "stored", kept)
    rows = corpus()[:30]
    assert found(spark, rows) == by_hand(rows)
    assert plans and not any("Exchange" in plan for plan in plans)
    assert "sets" not in purposes


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_NODES", 0)
    rows = corpus()
    assert found(spark, rows, Join(brute_force=8)) == by_hand(rows)
