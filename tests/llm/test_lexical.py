"""Lexical search against the scores of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendlake.llm import lexical, queries
from lendlake.llm.lexical import Entries, Search
from tests.compare import connect, difference
from tests.llm import cases

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, k=20):
    """(item_id, rank, doc_id, score) of every item row."""
    counts = [Counter(terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in counts]
    size, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        wanted, scores = terms(text), []
        for (doc, _), c, length in zip(docs, counts, n):
            m = 75 + 25 * length * size // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[t] + 1)))
                        * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in wanted if c[t])
            scores.append((-score, doc is None, doc))
        best = sorted((s for s in scores if s[0]), key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        out += [(item, r, doc, -score) for r, (score, _, doc) in enumerate(best, 1)]
    return Counter(out)


def found(spark, docs, items, search=Search()):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string").repartition(2)
    return Counter(map(tuple, lexical.rank_documents(cases.clashing(d), i, search).collect()))


ITEMS = [(1, cases.prose(1, 30)), (2, cases.prose(9, 12)), (2, cases.prose(4, 8)), (3, ""), (4, None),
         (None, "Alpha7 beta3 BETA3"), (5, "two words two"), (6, "... !!"), (7, "absent"), (8, "漢 é́ ß"),
         (9, cases.prose(99, 900))]
SMALL = Search(k=4, leaf=2, item_leaf=1, fanout=2, tree=7, items=3, entries=40, pass_entries=60, first=2)


@pytest.mark.parametrize("search", [Search(), SMALL, Search(k=3, leaf=1, tree=16, first=1)])
def test_equals_all_pairs(spark, search):
    docs = [(r[0], r[1]) for r in cases.rows()]
    docs += [(100 + i, cases.prose(i, 40 + i)) for i in range(120)]
    docs += [(300 + i, "Two words\x00two") for i in range(40)]
    assert found(spark, docs, ITEMS, search) == by_hand(docs, ITEMS, search.k)


def test_nothing_to_find(spark):
    assert not found(spark, [], ITEMS)
    assert not found(spark, [(1, None), (2, "")], ITEMS)
    assert not found(spark, [(1, "a b")], [])
    assert not found(spark, [(1, "a b")], [(1, None), (2, "c")])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_equals_sql(spark, size):
    path = f"/root/testdata/{size}"
    name = "op13_lexical_search"
    assert difference(queries.QUERIES[name](spark, path), connect(path), queries.ORACLE_SQL[name]) is None


def sparse(rows):
    ends = np.cumsum([0, *(np.count_nonzero(r) for r in rows)])
    return Entries(ends, np.concatenate([np.flatnonzero(r) for r in rows]),
                   np.concatenate([r[np.flatnonzero(r)] for r in rows]))


matrix = st.integers(1, 30).flatmap(lambda n: st.lists(
    st.lists(st.sampled_from([0, 0, 0, 1, 5, 9]), min_size=6, max_size=6), min_size=n, max_size=n))


@given(matrix, matrix, st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_bounds_drop_nothing_that_counts(documents, items, least):
    d, q = np.array(documents), np.array(items)
    groups = lexical.item_groups(
        [(i, {t: int(n) for t, n in enumerate(r) if n}) for i, r in enumerate(q) if r.any()],
        np.ones(6, dtype=np.int64), SMALL)
    got = set()
    for g in groups:
        i, j, s = lexical.dual_tree(sparse(d), g, np.full(len(g.numbers), least), SMALL)
        got |= set(zip(g.numbers[i].tolist(), j.tolist(), s.tolist()))
    scores = q @ d.T
    assert got == {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores)) if scores[i, j] >= least}


def test_pruning_saves_work(spark):
    """Most documents of the given table are never scored once an item's best are known."""
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in items for t in terms(x)}))}
    df = Counter(t for x in rows for t in set(terms(x)))
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[t] + 1)))
                        for t in vocabulary])
    dense = np.zeros((len(rows), len(vocabulary)), dtype=np.int64)
    for row, x in zip(dense, rows):
        for t, tf in Counter(terms(x)).items():
            if t in vocabulary:
                row[vocabulary[t]] = 10**9 * tf // (1000 * tf + 12 * 100)
    dense = dense[dense.any(axis=1)]
    dense = dense[np.argsort((dense * weights).argmax(axis=1), kind="stable")]
    counts = [(i, {vocabulary[t]: n for t, n in Counter(terms(x)).items()}) for i, x in enumerate(items)]
    (group,) = lexical.item_groups(counts, weights, Search())
    scores = group.levels[0] @ dense[:, group.terms].T
    least = np.sort(scores, axis=1)[:, -20]
    item, row, score = lexical.dual_tree(sparse(dense), group, least, Search())
    assert len(item) >= 20 * len(items) and (score >= least[item]).all()
    visited = []
    products = Entries.products
    Entries.products = lambda self, r, v: visited.append(len(r)) or products(self, r, v)
    try:
        lexical.dual_tree(sparse(dense), group, least, Search())
    finally:
        Entries.products = products
    assert sum(visited) < 0.75 * scores.size
