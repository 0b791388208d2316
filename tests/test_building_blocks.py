"""Ranks, look-back windows and bands against brute force."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lendlake.functions.bands import assign_risk_band
from lendlake.functions.keys import numbered, numbered_at_once
from lendlake.functions.latest import newest_scores
from lendlake.functions.ranking import dense_ranks_of_counts, ranks_descending
from lendlake.functions.sequences import look_back
from lendlake.operators.portfolio import score_trend
from tests.micro import customer, d, frame, micro, rows


@pytest.mark.parametrize("top", [5, 10**4, 10**7, 10**13])
def test_ranks(spark, top):
    rng = random.Random(top)
    values = [rng.randrange(top) for _ in range(300)] + [0, top, top]
    df = spark.createDataFrame([(v,) for v in values], "v BIGINT")
    ranks = {v: (r, dr) for v, r, dr in rows(ranks_descending(df, "v", "r", "dr"))}
    distinct = sorted(set(values), reverse=True)
    assert ranks == {v: (1 + sum(x > v for x in values), 1 + distinct.index(v)) for v in distinct}
    assert dict(rows(dense_ranks_of_counts(df, "v", "dr"))) == {
        v: 1 + i for i, v in enumerate(distinct)}


def brute_force(data):
    expected = {}
    ordered = sorted(data, key=lambda r: (r[1], r[2] is None, r[2] or date.min, r[0]))
    for i, (row_id, key, _, value) in enumerate(ordered):
        mine = [r for r in ordered[:i + 1] if r[1] == key]
        last = [r[3] for r in mine][-3:]
        expected[row_id] = (round(sum(last) / len(last), 9),
                            value - mine[-2][3] if len(mine) > 1 else None)
    return expected


@pytest.mark.parametrize("blocks", [None, 1, 2, 7, 60, 150])
def test_look_back_in_ranges_equals_one_window(spark, blocks):
    rng = random.Random(blocks or 0)
    data = []
    for row_id in range(200):
        key = 1 if rng.random() < 0.6 else rng.randrange(2, 12)
        # Few dates, so that one day of the large key exceeds a block; some missing.
        day = None if rng.random() < 0.1 else date(1969, 12, 30) + timedelta(rng.randrange(5))
        data.append((row_id, key, day, rng.randrange(1000)))
    df = spark.createDataFrame(data, "id BIGINT, k BIGINT, day DATE, v INT")
    value = F.col("v")
    result = look_back(
        df, "k", "day", "id",
        {"mean": lambda w: F.avg(value).over(w.rowsBetween(-2, 0)),
         "change": lambda w: value - F.lag(value).over(w)},
        reach=2, blocks=blocks)
    found = {r["id"]: (round(r["mean"], 9), r["change"]) for r in result.collect()}
    assert found == brute_force(data) and result.count() == len(data)


def test_score_trend_is_the_same_in_blocks(spark, star):
    assert rows(score_trend(star, blocks=7)) == rows(score_trend(star))


def test_bands_with_gap_and_overlap(spark):
    bands = frame(spark, "risk_category", [(1, "Low", 740, 900), (2, "Medium", 601, 750),
                                           (3, "High", 300, 590)])
    values = (300, 590, 591, 600, 601, 739, 740, 750, 751, 900)
    scores = spark.createDataFrame([(v,) for v in values], "score_value INT")
    found = dict(rows(assign_risk_band(scores, bands)))
    assert found == {300: 3, 590: 3, 591: None, 600: None, 601: 2, 739: 2, 740: 1, 750: 1,
                     751: 1, 900: 1}


def test_newest_score_takes_any_id_and_date(spark):
    scores = frame(spark, "credit_score", [
        ((1 << 62) + 1, 1, 500, d("9999-12-31"), 3), (1 << 62, 1, 501, d("9999-12-31"), 3),
        (-5, 2, 400, None, 3), (-7, 2, 401, d("0001-01-01"), 3), (3, 3, 402, None, 3),
        (4, 3, 403, None, None)])
    assert rows(newest_scores(scores), "customer_id", "score_value") == [(1, 500), (2, 401), (3, 403)]


def test_numbers_are_dense_and_ordered(spark):
    ids = [3, 10**15, 7, 10**12, 9, 10**15 + 1, -4]
    df = spark.createDataFrame([(i,) for i in ids], "i BIGINT").repartition(3)
    assert rows(numbered(df, ["i"], "n"), "i", "n") == [(x, n) for n, x in enumerate(sorted(ids))]
    wide = rows(numbered(df, ["i"], "n", F.lit(3)), "i", "n")
    assert wide == [(x, 3 * n) for n, x in enumerate(sorted(ids))]
    assert numbered(df.limit(0), ["i"], "n").count() == 0


def test_several_numbers_of_one_pass_are_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("i"), F.lit(-1).alias("g"))
    got = rows(numbered_at_once(df, ["i"], {"n": F.lit(1), "w": F.col("i") % 5,
                                            "g": F.when(F.col("i") % 3 == 0, 1).otherwise(0)}),
               "i", "n", "w", "g")
    assert got == [(i, i, sum(x % 5 for x in range(i)), (i + 2) // 3) for i in range(1000)]


def test_instalment_keys_stay_in_range():
    from lendlake.sources.star import INSTALMENT
    key = eval(INSTALMENT["emi_id"], {"l_orderkey": 10**11, "l_linenumber": 7,  # noqa: S307
                                      "l_partkey": 10**8, "l_suppkey": 10**7})
    assert 0 < key < 2**63


@pytest.mark.parametrize("bins", [1, 7, 20, 600])
def test_histogram_bins_are_even(spark, bins):
    from lendlake.operators.access import score_histogram
    t = micro(spark, customer=[customer(i) for i in range(601)], credit_score=[
        (i, i, 300 + i, d("2024-01-01"), 1) for i in range(601)])
    found = {}
    for start, _, n in rows(score_histogram(t, bins), "bin_start", "risk_level", "n"):
        found[start] = found.get(start, 0) + n
    assert len(found) == bins and sum(found.values()) == 601 and min(found) == 300
    assert max(found.values()) - min(found.values()) <= (2 if bins > 1 else 601)


def test_histogram_refuses_other_bins(spark, star):
    from lendlake.operators.access import score_histogram
    for bins in (0, 601):
        with pytest.raises(ValueError, match="bins"):
            score_histogram(star, bins)


def test_unbanded_scores_do_not_enter_the_moving_average(spark):
    t = micro(spark, customer=[customer(1)], credit_score=[
        (1, 1, 400, d("2024-01-01"), 3), (2, 1, 900, d("2024-02-01"), None),
        (3, 1, 500, d("2024-03-01"), 3)])
    assert rows(score_trend(t), "score_id", "rolling_avg_score", "score_change") == [
        (1, 400.0, None), (3, 450.0, 100)]
