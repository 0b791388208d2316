"""Mixing on awkward rows: weights, limits, and the realised order."""

import math
from collections import Counter, defaultdict

import pytest

from lendlake.llm import mixing
from lendlake.llm.mixing import Mix
from tests.llm import cases


def skewed(spark, extra=()):
    rows = [(i, cases.prose(i, 20), "en", "big", 0) for i in range(120)]
    rows += [(1000 + i, cases.prose(i, 10 + i % 7), "en", f"s{i % 4}", 0) for i in range(60)]
    return spark.createDataFrame([*rows, *extra], cases.SCHEMA).repartition(4)


def entropy(weights):
    return -sum(w * math.log(w) for w in weights if w)


def shares_of(spark, sizes):
    total = sum(sizes)
    return spark.createDataFrame([(f"s{i}", n, n / total) for i, n in enumerate(sizes)],
                                 "source string, source_tokens bigint, share double")


@pytest.mark.parametrize("goal", [0.7, 0.9, 0.99])
def test_exponent_meets_the_entropy(spark, goal):
    sizes = [9000, 500, 300, 150, 50]
    alpha = mixing.exponent(shares_of(spark, sizes), Mix(target_entropy=goal, repetition_limit=1e9))
    powers = [(n / sum(sizes)) ** alpha for n in sizes]
    assert entropy([p / sum(powers) for p in powers]) == pytest.approx(goal * math.log(5), abs=1e-4)


def test_exponent_is_one_where_shares_are_even_enough(spark):
    assert mixing.exponent(shares_of(spark, [30, 31, 29]), Mix()) == 1.0
    assert mixing.exponent(shares_of(spark, [30, 30]), Mix()) == 1.0
    assert mixing.exponent(shares_of(spark, [30]), Mix()) == 1.0
    assert mixing.exponent(shares_of(spark, [30]).where("share > 2"), Mix()) == 1.0


def test_repetition_limit_binds(spark):
    sizes = [9000, 500, 10]
    alpha = mixing.exponent(shares_of(spark, sizes), Mix(target_entropy=1.0, repetition_limit=5))
    assert (9000 / 10) ** (1 - alpha) == pytest.approx(5, rel=1e-4)
    alpha = mixing.exponent(shares_of(spark, sizes), Mix(1.0, 5, budget=9510))
    powers = [(n / 9510) ** alpha for n in sizes]
    assert powers[2] / sum(powers) * 9510 / 10 == pytest.approx(5, rel=1e-4)


def test_plan_follows_the_quotas(spark):
    mix = Mix(target_entropy=0.97, block_tokens=500)
    docs = skewed(spark)
    rows = mixing.plan_mixture(docs, mix).collect()
    thin = docs.select("source", mixing.word_count(mixing.text_of("text")).alias("n_tokens"))
    shares = mixing.source_shares(thin, "source", "n_tokens")
    quota = {r.source: (r.quota, r.source_tokens) for r in mixing.quotas(shares, mix).collect()}
    tokens, longest = Counter(), Counter()
    for r in rows:
        tokens[r.source] += r.n_tokens
        longest[r.source] = max(longest[r.source], r.n_tokens)
    for source, (q, n) in quota.items():
        assert q <= tokens[source] < q + longest[source] and q >= n - 1
    uses = Counter((r.doc_id, r.epoch) for r in rows)
    assert max(uses.values()) == 1
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.block].append(r)
    assert sorted(blocks) == list(range(len(blocks))) and len(blocks) > 4
    for members in blocks.values():
        assert sorted(r.position for r in members) == list(range(1, len(members) + 1))
    share = {b: sum(r.n_tokens for r in m if r.source == "big") / sum(r.n_tokens for r in m)
             for b, m in blocks.items()}
    whole = quota["big"][0] / sum(q for q, _ in quota.values())
    assert all(abs(x - whole) < 0.12 for x in share.values())


def test_epochs_are_permuted_differently(spark):
    mix = Mix(budget=40_000, repetition_limit=100.0, block_tokens=1 << 30)
    rows = mixing.plan_mixture(skewed(spark), mix).collect()
    order = {e: [r.doc_id for r in sorted(rows, key=lambda r: r.position) if r.source == "big"
                 and r.epoch == e] for e in (1, 2)}
    assert sorted(order[1]) == sorted(order[2]) and order[1] != order[2]


def test_rows_come_in_the_order_of_the_plan(spark):
    """Blocks one after the other, rows by position: the partitions read in order are the mixture."""
    docs, mix = skewed(spark), Mix(target_entropy=0.9, block_tokens=500)
    plan = sorted(mixing.plan_mixture(docs, mix).collect(), key=lambda r: (r.block, r.position))
    assert len({r.block for r in plan}) > 3
    assert [r.doc_id for r in mixing.mix_documents(docs, mix).collect()] == [r.doc_id for r in plan]


def test_awkward_rows_and_columns(spark):
    docs = cases.clashing(cases.docs(spark))
    out = mixing.mix_documents(docs, Mix(target_entropy=0.5))
    assert out.columns == docs.columns
    got, given = Counter(map(tuple, out.collect())), Counter(map(tuple, docs.collect()))
    assert set(got) == set(given) and all(got[k] >= n for k, n in given.items())
    plan = mixing.plan_mixture(docs, Mix(target_entropy=0.5))
    once = [r for r in plan.collect() if r.n_tokens == 0]
    assert sorted((r.epoch, str(r.doc_id)) for r in once) == [(1, "4"), (1, "5")]


def test_nothing_and_no_tokens(spark):
    assert mixing.plan_mixture(cases.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", None, 0)], cases.SCHEMA)
    assert mixing.plan_mixture(blank).count() == 2


def test_no_python_runs(spark):
    plan = mixing.mix_documents(cases.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
