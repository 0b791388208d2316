"""Whole-text encoding with a public tokenizer, one distinct word at a time.

A tokenizer that splits a text into words before it merges pieces gives the same ids for a text as
for its words in a row. The words of a corpus repeat, so each worker encodes a word once and
remembers its ids; the memory holds a bounded number of words and is emptied when full.

Where the cut between two words could differ from the tokenizer's own, the text goes to the
library whole: it then holds one of the control characters that Python counts as white space and
the tokenizers do not, or the name of a special token.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterable
from itertools import accumulate, chain, pairwise

import numpy as np

REMEMBERED_WORDS = 2_000_000
# Texts are cut into words in parts of about so many characters, to bound memory.
CHARS_AT_ONCE = 500_000
# A word of letters that neither case folding nor composing takes apart, and the marks that may
# close it: any ASCII ones but the apostrophe, which may begin a word's ending.
_PLAIN = re.compile(" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# How byte-level vocabularies write each byte: printable ones as themselves, the rest from U+0100.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES_OF = {b: chr(b) for b in _PRINTED} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_SPELLING = np.array([ord(BYTES_OF[b]) for b in range(256)], dtype="<u2")
# The merges alone must give the library's ids for these, or every word takes the long way.
_PROBES = ("the", " Then", " which", "Édition", " über", " Straßen", "of", " A", " ÀÑ", "zx")
_DOUBTFUL = "\x1c\x1d\x1e\x1f\x85"
# Beyond these characters lower-casing may depend on the context or the Unicode version.
_FOREIGN = re.compile("[^\x00-\u012f\u0132-\u0148]")
# A blank joins the word that follows it, other white space stands alone: so byte-level
# vocabularies see words. Lower-casing vocabularies drop white space, so any cut at it is safe.
_WORDS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def packed(lists: list[list[int]]) -> list[bytes]:
    """Each list of ids as 32-bit integers, made in one piece and cut."""
    data = array("I", chain.from_iterable(lists)).tobytes()
    ends = accumulate(map(len, lists), initial=0)
    return [data[4 * a:4 * b] for a, b in pairwise(ends)]


class WordEncoder:
    """Encodes texts to ids as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    As in the library, the name of a special token inside a text is that token, unless ``plain``
    makes it ordinary text; a text that holds such a name goes to the library whole. Words are kept
    in two generations: when the younger one is full it becomes the older one, and a word met there
    again moves back, so frequent words stay.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain
        names = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # How names begin, as a name may come about by lower-casing.
        self._doubtful = [*_DOUBTFUL, *([] if plain else {n[:2] for n in names})]
        self._remembered = remembered
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        alike = self._ids([" Aé", "aé"])
        self._folds = alike[0] == alike[1]
        self._direct = self._merged(list(_PROBES)) == self._ids(list(_PROBES))

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return packed([x.ids for x in found])

    def _merged(self, words: list[str]) -> list[bytes]:
        """The ids of plain words: the library's merges without its search for words."""
        if not words:
            return []
        joined = "\n".join(words)  # letters, and blanks before them
        if self._folds:
            joined = joined.replace(" ", "").lower()
        spelt = _SPELLING[np.frombuffer(joined.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le")
        tokenize = self._tokenizer.model.tokenize
        return packed([[t.id for t in tokenize(w)] for w in spelt.split(BYTES_OF[10])])

    def _learn(self, words: Iterable[str]) -> None:
        """Add words to the memory; a word with closing marks is its bare form and the marks."""
        young, old = self._young, self._old
        new: list[str] = []
        marked: list[tuple[str, str, str]] = []
        bares: dict[str, None] = {}
        other: dict[str, None] = {}
        for w in words:
            if w in old:
                young[w] = old[w]
                continue
            bare = w.rstrip(_MARKS)
            # Most words are ASCII letters alone.
            if not self._direct or not (
                    bare.lstrip(" ").isalpha() if bare.isascii() else _PLAIN.fullmatch(bare)):
                other[w] = None
            elif len(bare) == len(w):
                new.append(w)
            else:
                marked.append((w, bare, w[len(bare):]))
                bares[bare] = None
        young.update(zip(new, self._merged(new), strict=True))
        young.update((w, old[w]) for w in bares if w in old)
        other.update(dict.fromkeys([x[2] for x in marked]))
        for some, ids_of in ((bares, self._merged), (other, self._ids)):
            missing = [w for w in some if w not in young]
            young.update(zip(missing, ids_of(missing), strict=True))
        young.update([(w, young[bare] + young[marks]) for w, bare, marks in marked])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; nothing for null."""
        out: list[bytes] = []
        part: list[str] = []
        held = 0
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and looking for cycles would cost a fifth of the time
        try:
            for text in texts:
                part.append(text or "")
                held += len(part[-1])
                if held > CHARS_AT_ONCE:
                    out += self._encoded(part)
                    part, held = [], 0
            return out + self._encoded(part)
        finally:
            if collects:
                gc.enable()

    def _words(self, text: str) -> list[str]:
        if not self._folds:
            return _WORDS.findall(text)
        return (text.lower() if text.isascii() or not _FOREIGN.search(text) else text).split()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        if len(self._young) > self._remembered // 2:
            self._old, self._young = self._young, {}
        get, out = self._young.get, []
        missing: dict[str, None] = {}  # in the order they are met, as they lie in memory
        waiting: list[tuple[int, list[bytes | None], list[str]]] = []
        for text in texts:
            if any(x in text for x in self._doubtful):
                out += self._ids([text])
                continue
            words = self._words(text)
            found = list(map(get, words))
            if None in found:
                lost = [w for w, x in zip(words, found) if x is None]
                missing.update(dict.fromkeys(lost))
                waiting.append((len(out), found, lost))
                found = ()
            out.append(b"".join(found))
        self._learn(missing)
        find = self._young.__getitem__
        for at, found, lost in waiting:
            learnt = map(find, lost)
            out[at] = b"".join([next(learnt) if x is None else x for x in found])
        return out


ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, plain: bool = False, remembered: int = REMEMBERED_WORDS) -> WordEncoder:
    """The worker's encoder for a vocabulary file, made once for each worker process."""
    key = (path, plain, remembered)
    if key not in ENCODERS:
        ENCODERS[key] = WordEncoder(path, remembered, plain)
    return ENCODERS[key]
