"""Token alignment against a token-by-token version with the libraries' own encodings."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lendlake.llm import alignment
from lendlake.llm.shared import small_batches
from tests.llm import cases

FILES = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"))
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES.a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES.b)


def tokens(libraries, text):
    """(id, bytes) of both sides, nothing where a side does not spell the text."""
    a, b = libraries
    if not text:
        return [], []
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [x for x in range(256) if x not in printed]
    byte = {chr(x): x for x in printed} | {chr(256 + i): x for i, x in enumerate(others)}
    left = [(i, bytes(byte[c] for c in a.id_to_token(i)))
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
              else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in side) != whole for side in (left, right)):
        return [], []
    return left, right


def by_hand(libraries, rows):
    groups, pairs, count = [], [], Counter()
    for _, text in rows:
        left, right = tokens(libraries, text)
        ends = [{}, {}]
        for side, found in zip(ends, (left, right)):
            at = 0
            for k, (_, x) in enumerate(found):
                at += len(x)
                side[at] = k
        common = sorted(ends[0].keys() & ends[1].keys())
        made, linked, i, j = [], [], 0, 0
        for end in common:
            p, q = ends[0][end], ends[1][end]
            made.append(",".join(str(x) for x, _ in left[i:p + 1]) + "|"
                        + ",".join(str(x) for x, _ in right[j:q + 1]))
            linked.append((left[p][0], right[q][0]))
            i, j = p + 1, q + 1
        groups.append((len(left), len(right), made))
        pairs.append(linked)
        count.update(linked)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter(
        (doc, n_a, n_b, len(made), len(linked), sum(count[x] == best[x[1]] for x in linked),
         sum(count[x] for x in linked),
         hashlib.sha256(";".join(made).encode()).hexdigest() if made else "")
        for (doc, _), (n_a, n_b, made), linked in zip(rows, groups, pairs))


def found(df, **options):
    aligned = alignment.align(df, FILES, **options)
    return Counter(tuple(r[n] for n in NAMES) for r in alignment.digests(
        aligned, alignment.link_counts(aligned)).collect())


ODD = ["<|endoftext|> and <s> or <0x0A>", "a▁b", "▁", "  two  blanks  ", "\n\nlines\r\n\tand tabs \n",
       "漢字 \U0001f600 é́ \x1c \x85  ", "x" * 3000, " " * 50, "<unk></s>", "don't WE'LL 12345", "\x00 nul"]


@pytest.mark.parametrize("steps", [3, 64, alignment.STEPS])
def test_equals_token_by_token(spark, libraries, steps):
    rows = [(r[0], r[1]) for r in cases.rows()] + [(100 + i, x) for i, x in enumerate(ODD)]
    if steps == 3:  # very many pieces: the long texts are left to the other two
        rows = [r for r in rows if len(r[1] or "") < 3500]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert found(cases.clashing(df), steps=steps) == by_hand(libraries, rows)


def test_texts_that_end_in_one_blank(spark, libraries):
    rows = list(enumerate(["a ", "two words ", " ", "  ", "漢 ", "line\n ", "no end", "two  ", "a▁ "]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(tokens(libraries, x)[1] for _, x in rows if "▁" not in x)
    assert found(df) == found(df, steps=3) == by_hand(libraries, rows)


def test_given_documents(spark, libraries):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df, steps=1000) == by_hand(
        libraries, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_table_and_texts(spark):
    assert not found(cases.empty(spark))
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert found(df) == Counter([(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")])


def test_groups_cover_all_tokens(spark):
    for r in alignment.unpacked(alignment.align(cases.docs(spark), FILES, steps=500)).collect():
        assert sum(r.a_sizes) == len(r.a_ids) and sum(r.b_sizes) == len(r.b_ids)
        assert len(r.a_sizes) == len(r.b_sizes) and all(r.a_sizes) and all(r.b_sizes)


sides = st.lists(st.integers(1, 4), min_size=1, max_size=40)


@given(sides, sides, st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_pieces_join_to_the_whole_merge(x, y, steps):
    a, b = np.cumsum(x), np.cumsum(y)
    i, j = alignment.diagonal_cuts(a, b, steps)
    assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all()
    assert (np.diff(i) + np.diff(j) <= steps + 1).all()
    ends = [np.concatenate(c) for c in zip(*(
        np.array(alignment.common_ends(a[p:q], b[r:s])) + [[p], [r]]
        for p, q, r, s in zip(i, i[1:], j, j[1:])))]
    whole = alignment.common_ends(a, b)
    assert [list(c) for c in ends] == [list(c) for c in whole]


@given(st.text(alphabet=st.sampled_from(list("ab é\n▁<0x41>漢  ")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_segments_equal_the_library(text):
    model = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    encoder = alignment._piece_encoder(FILES.b)
    ids = encoder.encode([text])[0]
    if text and ids is not None:
        assert np.frombuffer(ids, "<i4").tolist() == model.encode(text)


def test_remembered_segments_are_renewed():
    model = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    encoder = alignment.PieceEncoder(FILES.b, remembered=20)
    for seed in range(30):
        text = cases.prose(seed % 7, 25) + ("▁" if seed % 5 == 0 else "")
        ids = encoder.encode([text, "the same"])
        assert (ids[0] is None) == (seed % 5 == 0)
        assert ids[0] is None or np.frombuffer(ids[0], "<i4").tolist() == model.encode(text)
        assert np.frombuffer(ids[1], "<i4").tolist() == model.encode("the same")


def test_wide_rows_pass_in_small_batches(spark, monkeypatch):
    """All jobs read and pass token lists in small batches, and the session's settings come back."""
    key, sizes, plans = "spark.sql.execution.arrow.maxRecordsPerBatch", [], []

    def kept(df, purpose, **options):
        sizes.append((purpose, int(spark.conf.get(key))))
        return stored(df, purpose, **options)

    def asked(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return 4

    stored, before = alignment.stored, spark.conf.get(key)
    monkeypatch.setattr(alignment, "stored", kept)
    monkeypatch.setattr(alignment, "spread", asked)
    found(cases.docs(spark), steps=500)
    assert {x for x, _ in sizes} == {"token-pieces", "stitched-texts", "alignment-digests"}
    assert all(n <= 500 for _, n in sizes) and spark.conf.get(key) == before
    assert plans and not any("Exchange" in plan for plan in plans)
    rows = spark.range(0, 1200, 1, 1)
    with small_batches(spark):
        counted = rows.mapInArrow(lambda batches: (
            pa.RecordBatch.from_arrays([pa.array([x.num_rows])], ["n"]) for x in batches), "n bigint")
        assert max(r.n for r in counted.collect()) == 500
    with pytest.raises(ValueError), small_batches(spark):
        raise ValueError
    assert spark.conf.get(key) == before


def test_names_of_ids_are_made_once():
    """Batches share the table of written ids, which takes longer to make than a batch to write."""
    flat = {x: np.array(v, dtype=np.int64) for x, v in
            {"a_ids": [7, 12, 3], "b_ids": [5, 40], "a_sizes": [2, 1], "b_sizes": [1, 1]}.items()}
    alignment._names.cache_clear()
    for _ in range(3):
        (first, last, text, taken), = alignment.written_groups(flat, 50)
        assert (first, last, text.tobytes(), taken.tolist()) == (0, 2, b"7,12|5;3|40;", [7, 5])
    assert alignment._names.cache_info().misses == 1


def test_segments_are_spelt_together(monkeypatch):
    """One call spells all new segments; only those whose bytes differ from the text's have no ids."""
    encoder = alignment.PieceEncoder(FILES.b, remembered=100)
    assert encoder._segments("a bc d") == ["a", "bc", "d"] and encoder._segments(" a  b ") == [" a", " b", ""]
    texts = ["a\u2581b cd", "cd  ef", "", " x ", "cd gh", "\u2581"]
    model = sentencepiece.SentencePieceProcessor(model_file=FILES.b)
    got = encoder.encode(texts)
    assert [x is None for x in got] == [True, False, False, False, False, True]
    assert [np.frombuffer(got[i], "<i4").tolist() for i in (1, 3, 4)] == [model.encode(texts[i]) for i in (1, 3, 4)]
    assert encoder.encode(texts[::-1]) == got[::-1]
