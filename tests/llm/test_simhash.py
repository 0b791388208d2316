"""SimHash near duplicates against the comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lendlake.llm import simhash
from lendlake.llm.simhash import Near
from tests.llm import cases


def fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=2):
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def by_hand(rows):
    prints = [fingerprint(t) for _, t in rows]
    groups = {}
    for (i, _), top in zip(rows, found := components(prints)):
        groups.setdefault(top, []).append(i)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((r[0], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, found))


def corpus():
    rows, k = [], 100
    for seed in range(25):
        words = cases.prose(seed, 300).split(" ")
        for edit in range(5):
            rows.append((k, " ".join([*words[:edit * 20], f"Edit{edit}", *words[edit * 20 + 1:]])))
            k += 1
    return rows


@pytest.mark.parametrize("near", [Near(), Near(leaf=8, fanout=2), Near(leaf=3, fanout=3)])
def test_equals_all_pairs(spark, near):
    rows = [(r[0], r[1]) for r in cases.rows()] + corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(map(tuple, simhash.near_duplicates(cases.clashing(df), near).collect())) == by_hand(rows)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert Counter(map(tuple, simhash.near_duplicates(df, Near(leaf=64)).collect())) == by_hand(rows)


def test_balls_of_alike_fingerprints(spark):
    """Balls, chains of two-bit steps and lone fingerprints over many leaves."""
    draw, prints = random.Random(5), set()
    for _ in range(3):
        middle = draw.getrandbits(64)
        prints |= {middle ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(250)}
    at = draw.getrandbits(64)
    for _ in range(200):
        at ^= (1 << draw.randrange(64)) | (1 << draw.randrange(64))
        prints.add(at)
    prints = sorted(prints | {draw.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1})
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp bigint")
    for near in (Near(leaf=16, fanout=4), Near()):
        edges = simhash.links(df, near).collect()
        number = {p - (p >> 63 << 64): k for k, p in enumerate(prints)}
        i, j = (np.array([number[e[k]] for e in edges]) for k in (0, 1))
        top = simhash.roots(len(prints), i, j)
        assert top.tolist() == components(prints)
        assert all(((e[0] ^ e[1]) & (2**64 - 1)) for e in edges) and len(edges) < 3 * len(prints)


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []


def test_gray_rank_orders_the_gray_code(spark):
    values = [*range(64), 2**62, 2**63 - 1]
    df = spark.createDataFrame([(x ^ x >> 1,) for x in values], "fp bigint")
    found = [r.r + 2**63 for r in df.select(simhash.gray_rank(df.fp).alias("r")).collect()]
    assert found == values


words = st.lists(st.sampled_from(["a", "B", "É", "x\x0bY", " ", "\x1f", "漢"]), max_size=9)


@given(words, st.sampled_from([" ", "\t\n", "  "]))
@settings(max_examples=200, deadline=None)
def test_fingerprints_equal_the_definition(parts, gap):
    text = gap.join(parts)
    assert simhash.fingerprint(text, 3) & (2**64 - 1) == fingerprint(text)
