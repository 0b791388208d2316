"""Personal data: pattern spans against Python's re, disclosing terms on a made-up corpus."""

import hashlib
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lendlake.llm import pii
from tests.llm import cases

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in value.split(".")),
            "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
            "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def by_hand(text):
    found = [(m.start(), rank, m.end(), kind) for rank, kind in enumerate(pii.KINDS)
             for m in re.finditer(PLAIN[kind], text or "") if valid(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


HARD = ["mail a.b@c-d.example.com, x_y@z.org_q@w.net", "a@b", "@x.y", "a@b.c@d.e", "é@x.fr \U0001f600 q@r.st",
        "1.2.3.4.5.6.7.8", "256.1.1.1 255.0255.1.1", "001.02.3.4", "1..2.3.4", "1.2.3", "9.9.9.9999",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111111 1 4111111111111111",
        "+1 (456) 555-2186 +12 +123456789. +1-2-3-4-5-6-7-8-9-", "++123456789", "5" * 3000,
        "a" * 4000 + "@", ("4111 1111 1111 1111 " * 40), "+49 4111 1111 1111 1111", "", None,
        "x@y.z" * 20, "1.1.1.1" * 9]
PIECE = st.sampled_from(["a", "B7", "@", ".", "-", "_", "+", " ", "1", "23", "4111111111111111", "(", ")",
                         "256", "255", "é", "\U0001f600", "x@y.z", "\n", "1.2.3.4", "+123456789"])


def spans(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    out = df.select("i", pii.written(pii.base_spans(pii.text_of("text"))).alias("s")).collect()
    return [r.s for r in sorted(out)]


def test_hard_texts(spark):
    assert spans(spark, HARD) == [by_hand(t) for t in HARD]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=25).map("".join), min_size=60, max_size=90))
def test_any_text(spark, texts):
    assert spans(spark, texts) == [by_hand(t) for t in texts]


def corpus(spark):
    told = "zorblax"
    rows = [(i, f"some filler{i} text by {told} about jane@corp.example today{i % 3}") for i in range(5)]
    rows += [(10 + i, f"plain words {cases.prose(i, 30)} some text by about") for i in range(40)]
    rows += [(60, f"a note on Zorblax, and {told}."), (61, "zorblaxes are other"), (62, None), (63, "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_disclosing_term_is_found_everywhere(spark):
    found = {r.doc_id: r.pii_spans for r in pii.find_personal_data(
        corpus(spark), pii.Disclosure(generalise_at=0.8)).collect()}
    terms = {i: [(s.start, s.finish) for s in x if s.kind == "term"] for i, x in found.items()}
    text = "a note on Zorblax, and zorblax."
    assert [text[a:b] for a, b in terms[60]] == ["Zorblax", "zorblax"]
    assert terms[61] == [] and not terms[62] and not terms[63]
    assert all(terms[i] for i in range(5)) and all(not terms[i] for i in range(10, 50))


def test_disclosure_is_the_share_of_information(spark):
    import math
    rules = pii.Disclosure(generalise_at=0.1)
    got = {r.term: r.disclosure for r in pii.disclosing_terms(corpus(spark), rules).collect()}
    n, pair, entity, term = 49, 5, 5, 6
    assert got["zorblax"] == pytest.approx(
        math.log(n * pair / (entity * term)) / math.log(n / entity))
    assert "some" not in got and got["today"] == 1.0


def test_sanitised_text(spark):
    rules = pii.Disclosure(generalise_at=0.8, remove_at=2.0)
    docs = cases.clashing(corpus(spark))
    out = pii.sanitise(docs, rules)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[60] == "a note on [TERM], and [TERM]." and text[62] is None and text[63] == ""
    assert "jane" not in text[0] and "[EMAIL]" in text[0] and "[TERM]" in text[0]
    gone = pii.sanitise(docs, pii.Disclosure(generalise_at=0.8, remove_at=0.8))
    assert {r.doc_id: r.text for r in gone.collect()}[60] == "a note on , and ."


def test_far_words_of_an_entity_of_one_document(spark):
    """Counts are of whole documents, and an entity needs no second one; against plain Python."""
    import math
    far = "quixotry " + "common filler words " * 200
    rows = [(1, far + "mail a@b.example, +49 30 1234567 or 10.1.2.3"), (2, "a@b.example common twice"),
            (3, "10.9.9.9 twice common"), *((i, f"common words, filler {i}") for i in range(4, 60))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rules = pii.Disclosure(generalise_at=0.6)
    words = {i: set(re.findall("[a-z]{3,}", t)) for i, t in rows}
    found = {1: {"a@b.example", "+49 30 1234567", "10.1.2.3"}, 2: {"a@b.example"}, 3: {"10.9.9.9"}}
    want = {}
    for e in set().union(*found.values()):
        own = math.log(len(rows) / sum(e in x for x in found.values()))
        for w in set().union(*words.values()):
            both = sum(e in x and w in words[i] for i, x in found.items())
            if both:
                told = math.log(len(rows) * both / sum(e in x for x in found.values())
                                / sum(w in x for x in words.values()))
                want[w] = max(want.get(w, -9), told / own)
    want = {w: x for w, x in want.items() if x >= rules.generalise_at}
    got = {r.term: r.disclosure for r in pii.disclosing_terms(docs, rules).collect()}
    assert got == pytest.approx(want) and got["quixotry"] == 1.0 and "common" not in got
    spans = {r.doc_id: r.pii_spans for r in pii.find_personal_data(docs, pii.Disclosure()).collect()}
    assert (0, 8, "term") in {(s.start, s.finish, s.kind) for s in spans[1]}


def test_query_over_awkward_rows(spark, tmp_path):
    from lendlake.llm import queries
    rows = [(*r[:1], t or r[1], *r[2:]) for r, t in zip(cases.rows(), HARD)]
    spark.createDataFrame(rows, cases.SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r)[:6] for r in queries.op5_personal_data(spark, str(tmp_path)).collect())
    want = Counter()
    for i, t, *_ in rows:
        s = by_hand(t)
        kinds = Counter(x.split(":")[0] for x in s.split(",") if x)
        want[i, *(kinds[k] for k in pii.KINDS), hashlib.sha256(s.encode()).hexdigest()] += 1
    assert got == want


def test_nothing(spark):
    assert pii.find_personal_data(cases.empty(spark)).count() == 0


def test_no_python_runs(spark):
    plan = pii.find_personal_data(cases.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
