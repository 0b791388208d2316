"""Exact dedup and sharding on awkward rows, against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendlake.llm import queries, exact_dedup, sharding
from tests.llm import cases


def by_hand(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        kept_one = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == keep and not kept_one
            kept_one |= kept
            out[i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


DIGESTS = {"sha256": exact_dedup.sha256,
           "length only": lambda t: F.pmod(F.length(t), F.lit(3)).cast("string"),
           "all alike": lambda t: F.substring(t, 1, 0)}


@pytest.mark.parametrize("digest", DIGESTS)
@pytest.mark.parametrize("salts", [1, 7])
def test_marks_equal_hand_count(spark, digest, salts):
    found = exact_dedup.mark_duplicates(
        cases.clashing(cases.docs(spark)), salts=salts, digest=DIGESTS[digest])
    got = Counter(map(tuple, found.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == by_hand(cases.rows())


def test_drop_keeps_one_row_a_text_and_all_columns(spark):
    docs = cases.clashing(cases.docs(spark))
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    texts = [r.text or "" for r in left.collect()]
    assert Counter(texts) == Counter({t or "": 1 for _, t, *_ in cases.rows()})


def test_dedup_of_nothing(spark):
    assert exact_dedup.mark_duplicates(cases.empty(spark)).count() == 0


def test_no_python_runs(spark):
    plan = exact_dedup.mark_duplicates(cases.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_matrix_has_the_sums_it_must(spark):
    rows = [0, 5, 17, 300, 1]
    drawn = sharding.communication_matrix(rows, 4, seed=3)
    assert drawn.sum(axis=1).tolist() == rows and (drawn >= 0).all()
    assert sorted(drawn.sum(axis=0).tolist()) == [80, 81, 81, 81]
    assert (drawn == sharding.communication_matrix(rows, 4, seed=3)).all()


def test_matrix_is_hypergeometric():
    """Mean and variance of one entry over many seeds."""
    seen = np.array([sharding.communication_matrix([40, 60], 4, s)[0, 0] for s in range(3000)])
    assert abs(seen.mean() - 10) < 0.15
    assert abs(seen.var() - 25 * 0.4 * 0.6 * 75 / 99) < 0.4


def test_matrix_beyond_what_numpy_draws():
    rows = [3 * 10**9, 10**9 + 7, 5]
    drawn = sharding.communication_matrix(rows, 3, seed=1)
    assert drawn.sum(axis=1).tolist() == rows
    assert np.ptp(drawn.sum(axis=0)) <= 1


@pytest.mark.parametrize("seed", [0, 1])
def test_shards_are_even_and_gapless(spark, seed):
    docs = cases.clashing(cases.docs(spark))
    found = sharding.shuffle_to_shards(docs, 4, seed, partitions=5).collect()
    assert len(found) == len(cases.rows())
    assert Counter((r.doc_id, r.text) for r in found) == Counter(r[:2] for r in cases.rows())
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(4))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))


def test_sharding_is_a_uniform_shuffle(spark):
    """Each row reaches each shard about equally often over seeds; order follows nothing."""
    docs = spark.range(40).withColumnRenamed("id", "doc_id")
    seen = np.zeros((40, 4))
    for seed in range(40):
        for r in sharding.shuffle_to_shards(docs, 4, seed, partitions=4).collect():
            seen[r.doc_id, r.shard] += 1
    assert abs(seen - 10).max() < 10 and (seen.sum(axis=0) == 400).all()
    chi = ((seen - 10) ** 2 / 10).sum()
    assert 60 < chi < 190  # 117 degrees of freedom, a little less spread


def test_more_shards_than_rows_and_none(spark):
    few = sharding.shuffle_to_shards(spark.range(3), 8).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert sharding.shuffle_to_shards(cases.empty(spark), 8).count() == 0


def test_queries_derive_sizes(spark, tmp_path):
    from lendlake.llm import queries
    cases.docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard)
                  for r in queries.op9_sharding(spark, str(tmp_path)).collect())
    assert got == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None)
                          for i, t, *_ in cases.rows())


def test_large_draws_have_the_distribution():
    """Beyond numpy's limit: mean, deviation and range; below it the same formula agrees with numpy."""
    random = np.random.default_rng(4)
    good, bad, places = 3 * 10**9, 10**9, 10**6
    drawn = np.array([sharding._large(random, good, bad, places) for _ in range(1500)])
    deviation = (places * 0.75 * 0.25) ** 0.5
    assert abs(drawn.mean() - 750_000) < 5 * deviation / 1500**0.5
    assert abs(drawn.std() / deviation - 1) < 0.1
    for good, bad, places in ((10**9, 3, 10**9), (5, 2 * 10**9, 10**9), (2 * 10**9, 0, 7)):
        x = sharding._large(random, good, bad, places)
        assert max(0, places - bad) <= x <= min(good, places)


def test_sharding_query_derives_from_whole_documents(spark):
    """Size and checksum of every text, gapless slots and even shards, by hand."""
    import zlib
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()} and len(rows) == len(texts)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(shards) == list(range(16))
    assert all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
