"""Encoding, token files and packing: round trips against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lendlake.llm import packing, token_files
from lendlake.llm.encoding import REMEMBERED_WORDS, WordEncoder
from tests.llm import cases

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def library(path, plain=False):
    found = Tokenizer.from_file(path)
    if plain:
        found.encode_special_tokens = True
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


LIBRARY = {p: library(p) for p in (WORD, BYTE)}
ENCODERS = {p: WordEncoder(p, remembered=50) for p in (WORD, BYTE)}
PIECES = st.sampled_from(["the", "The", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "é",
                          "İ", "ß", "ǅ", "'s", "'", ".", "...", "?!", "42", "٥", "<|endoftext|>",
                          "<|startoftext|>", "<|ENDOFTEXT|>",
                          "\U0001f600", "Σ", "straße", "-", "_", "x" * 80])


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join) | st.text(max_size=20), max_size=4))
def test_ids_are_the_library_s(path, texts):
    got = [np.frombuffer(x, "<u4").tolist() for x in ENCODERS[path].encode([*texts, None])]
    assert got == [*map(LIBRARY[path], texts), []]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_names_of_special_tokens(path):
    """By default a name is the token, as in the library; ``plain`` makes it ordinary text."""
    texts = ["a <|endoftext|> b", "<|startoftext|>a<|endoftext|>", "A <|EndOfText|> b", "plain"]
    for plain in (False, True):
        got = WordEncoder(path, plain=plain).encode(texts)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [*map(library(path, plain), texts)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_a_word_is_merged_and_looked_up_once(path, monkeypatch):
    """A bare form in the older memory is not merged again for its closing marks, and only the words
    of a text that were missing are looked up after they are learnt."""
    class Counted(dict):
        looked_up = 0

        def __getitem__(self, word):
            Counted.looked_up += 1
            return super().__getitem__(word)

    encoder = WordEncoder(path, remembered=6)
    encoder.encode(["one two three four"])
    assert len(encoder._young) > 3
    merged, words = encoder._merged, []
    monkeypatch.setattr(encoder, "_merged", lambda some: words.extend(some) or merged(some))
    texts = ["one, two", "one two; five"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [*map(LIBRARY[path], texts)]
    assert [w.strip() for w in words].count("two") == 0 and [w.strip() for w in words].count("five") == 1
    encoder = WordEncoder(path, remembered=100)
    encoder.encode(["one two three"])
    encoder._young = Counted(encoder._young)
    text = "one two three two six"
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == LIBRARY[path](text)
    assert Counted.looked_up == 1


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_checksums_give_back_the_encoders_memory(monkeypatch):
    """A worker that encoded and then sums holds no remembered words any more."""
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, step, _):
            return list(step(iter(())))

    held = {"vocabulary": object()}
    monkeypatch.setattr(token_files, "ENCODERS", held)
    assert token_files.checksums(Rows()) == [] and not held
    assert token_files.REMEMBERED_WORDS < REMEMBERED_WORDS


def test_token_files_round_trip(spark, tmp_path):
    folder = f"{tmp_path}/ids"
    token_files.write_token_files(cases.clashing(cases.docs(spark)), folder, WORD, 1, files=3)
    rows = token_files.read_token_files(spark, folder)
    found = rows.orderBy("start").collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(r[0]) for r in cases.rows())
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    start = 0
    texts = {}
    for i, t, *_ in cases.rows():
        texts.setdefault(i, set()).add(tuple([*LIBRARY[WORD](t), 1]))
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) and tuple(r.ids) in texts[r.doc_id]
        start += r.n_tokens
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.checksums(rows).collect()}
    assert sums == {(r.doc_id, r.start): crc(r.ids) for r in found}


def test_token_files_have_bloom_filters_and_prune(spark, tmp_path):
    import pyarrow.orc as orc
    folder = tmp_path / "ids"
    token_files.write_token_files(cases.docs(spark), str(folder), WORD, 1, files=2)
    files = [orc.ORCFile(str(f)) for f in sorted(folder.glob("*.orc"))]
    assert sum(f.nrows for f in files) == len(cases.rows())
    plan = token_files.read_token_files(spark, str(folder)).where("doc_id = 9")
    assert "EqualTo(doc_id,9)" in plan._jdf.queryExecution().toString()
    assert plan.count() == 1


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_token_files(cases.empty(spark), f"{tmp_path}/ids", WORD, 1)
    assert token_files.checksums(token_files.read_token_files(spark, f"{tmp_path}/ids")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), min_size=1, max_size=12))
def test_plan_uses_every_piece_once(counts):
    used = dict.fromkeys(counts, 0)
    for times, pattern in packing.plan_sequences(counts, 32):
        assert sum(k * n for k, n in pattern.items()) <= 32
        for k, n in pattern.items():
            used[k] += times * n
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6))
def test_filling_is_the_fullest(counts):
    seed, capacity = max(counts), 24
    pattern = packing.fullest(counts, seed, capacity)
    sums = {0}
    for k, n in counts.items():
        for _ in range(n - (k == seed)):
            sums |= {s + k for s in sums}
    assert sum(k * n for k, n in pattern.items()) == seed + max(s for s in sums if s <= capacity - seed)
    assert all(n <= counts[k] for k, n in pattern.items()) and pattern[seed] >= 1


def test_packing_places_every_piece_gapless(spark):
    rows = packing.pack_documents(cases.clashing(cases.docs(spark)), BYTE, 0, capacity=64).collect()
    pieces = {}
    for i, t, *_ in cases.rows():
        ids = [*LIBRARY[BYTE](t), 0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, k, a, b - a, crc(ids[a:b]))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 64
    assert len(sequences) <= -(-sum(r.length for r in rows) // 64) + 1


def test_packing_nothing(spark):
    assert packing.pack_documents(cases.empty(spark), BYTE, 0).count() == 0
