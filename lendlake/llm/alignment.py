"""Aligning two tokenizers' tokens of the same texts by merge-path partitioning.

Both token sequences of a text are ascending lists of byte ends. Merging them tells where ends of
both meet; between two such places lies a group of tokens that cover the same bytes. The merge is
cut into pieces of equal work: for each multiple of ``steps`` a binary search along a diagonal of
the merge finds how many tokens of either side come before it. Pieces are independent: each finds
the overlaps that end in it, and what its last tokens leave open is stitched to the next piece.

A text of one piece is merged where it was encoded. Pieces of longer texts are stored, dealt to
tasks by text and number, merged there, and brought together again in their order.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.encoding import BYTES_OF, ENCODERS, encoder, packed
from lendlake.llm.shared import small_batches, spread, stored

STEPS = 1 << 16
ROWS_AT_ONCE = 200
# Words of A, and segments of B, that a worker keeps with their ids (about 150 bytes each): most words
# of a corpus are rare, and each that is met again after it was dropped is encoded again.
REMEMBERED_WORDS = 900_000
TOKENS_AT_ONCE = 500_000
_SEGMENT = re.compile(" *[^ ]+| +")
# Token lists are wide; small row groups keep what a writer holds in memory small.
_ROW_GROUP = {"parquet.block.size": str(16 << 20), "compression": "zstd"}
_SIDES = ("a_ids", "b_ids", "a_sizes", "b_sizes")
# Lists are packed, as little-endian 32-bit integers: the JVM moves them as one value each.
ALIGNED = "doc_id bigint, " + ", ".join(f"{x} binary" for x in _SIDES)


@dataclass(frozen=True)
class Vocabularies:
    """Files of the byte-level tokenizer A and the piece tokenizer B."""

    a: str
    b: str


class PieceEncoder:
    """Encodes texts to ids as ``SentencePieceProcessor.encode`` does, one distinct segment at a time.

    A segment is a run of blanks and what follows it up to the next blank. If no piece holds a blank
    after another character, no merge crosses a border between segments, and a text's ids are its
    segments' ids in a row; otherwise texts are encoded whole. Segments are remembered in two
    generations. Ids are None where the pieces' bytes are not the text's own. A blank that ends a
    text is a segment of its own, for which the library has no text: it gives an empty one no ids.
    """

    def __init__(self, path: str, remembered: int) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.bytes_of = [
            bytes([int(x[3:5], 16)]) if self._model.is_byte(i) else
            b"" if self._model.is_control(i) or self._model.is_unknown(i) else
            x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self._whole = any("▁" in x.lstrip("▁") for x in pieces)
        self._bytes_of = self.bytes_of.__getitem__
        self._sizes = np.array([len(x) for x in self.bytes_of], dtype=np.int64)
        self._last_blank = self._model.encode("a ")[len(self._model.encode("a")):]
        self._half = remembered // 2
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._changed: set[str] = set()

    def _learn(self, new: Iterable[str]) -> None:
        missing = []
        for x in new:
            if x in self._old:
                self._young[x] = self._old[x]
            else:
                missing.append(x)
        if not missing:
            return
        # The library puts a blank of its own before a text.
        found = [x or self._last_blank for x in self._model.encode(missing, num_threads=1)]
        self._young.update(zip(missing, packed(found), strict=True))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        spelt = b"".join(map(self._bytes_of, ids.tolist()))
        stops = np.cumsum(self._sizes[ids], dtype=np.int64)
        stops = np.concatenate([[0], stops])[np.cumsum([0, *map(len, found)])].tolist()
        self._changed.update([x for x, (i, j) in zip(missing, pairwise(stops), strict=True)
                              if spelt[i:j] != f" {x}".encode()])

    def _segments(self, text: str) -> list[str]:
        """The segments of a text, as it reads after a blank, without the blank each begins with."""
        if self._whole:
            return [text]
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in _SEGMENT.findall(f" {text}")]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text (as it reads after a blank), as 32-bit integers."""
        if len(self._young) > self._half:
            self._old, self._young = self._young, {}
            self._changed &= self._old.keys()
        get, missing, out = self._young.get, {}, []
        collects = gc.isenabled()
        gc.disable()  # as in WordEncoder: nothing here is cyclic
        try:
            for text in texts:
                cut = self._segments(text)
                found = list(map(get, cut))
                lost = [x for x, ids in zip(cut, found) if ids is None] if None in found else []
                missing.update(dict.fromkeys(lost))
                out.append((cut, found, lost))
            self._learn(missing)
            find = self._young.__getitem__
            ids_of = []
            for cut, found, lost in out:
                learnt = map(find, lost)
                changed = self._changed and not self._changed.isdisjoint(cut)
                ids_of.append(None if changed else b"".join(
                    [next(learnt) if x is None else x for x in found] if lost else found))
            return ids_of
        finally:
            if collects:
                gc.enable()


_PIECE_ENCODERS: dict[str, PieceEncoder] = {}


def _piece_encoder(path: str) -> PieceEncoder:
    if path not in _PIECE_ENCODERS:
        _PIECE_ENCODERS[path] = PieceEncoder(path, REMEMBERED_WORDS)
    return _PIECE_ENCODERS[path]


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    back = {c: b for b, c in BYTES_OF.items()}
    tokens = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(tokens.values()) + 1)
    for token, i in tokens.items():
        out[i] = bytes(back.get(c, 0) for c in token)
    return out


_SIZES: dict[str, np.ndarray] = {}


def _byte_level_sizes(path: str) -> np.ndarray:
    if path not in _SIZES:
        _SIZES[path] = np.array([len(x) for x in byte_level_tokens(path)], dtype=np.int32)
    return _SIZES[path]


def _forget() -> None:
    """Give back the memory of a worker's encoders, which the steps after encoding do not need."""
    ENCODERS.clear()
    _PIECE_ENCODERS.clear()


def diagonal_cuts(a: np.ndarray, b: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists is cut every ``steps`` steps: how many members of
    ``a`` and of ``b`` come before each cut, the beginning and the end included.

    Of equal members that of ``a`` comes first; a cut between two equal ones moves past both. All
    diagonals are searched at once, halving the range of each.
    """
    d = np.arange(steps, len(a) + len(b), steps)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        open_ = low < high
        i = (low + high) // 2
        # Member i of a belongs before the diagonal if it is no later than b's last one there.
        before = open_ & (a[np.minimum(i, len(a) - 1)] <= b[np.clip(d - 1 - i, 0, len(b) - 1)])
        low = np.where(before, i + 1, low)
        high = np.where(open_ & ~before, i, high)
    i, j = low, d - low
    equal = (i > 0) & (j < len(b))
    equal[equal] = a[i[equal] - 1] == b[j[equal]]
    j = j + equal
    return np.concatenate([[0], i, [len(a)]]), np.concatenate([[0], j, [len(b)]])


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many members of two ascending lists lie up to each value they share."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    met = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return met + 1, at[met] + 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<i4").tobytes() for x in parts], type=pa.binary())


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes, in tokens of either side, of the groups that end in a piece, then of the open rest."""
    i, j = common_ends(a, b)
    return (np.diff(np.concatenate([[0], i, [len(a)]])), np.diff(np.concatenate([[0], j, [len(b)]])))


_NONE = np.zeros(0, dtype=np.int32)
_PIECES = "doc_id bigint, task int, row bigint, piece int, pieces int, " + ", ".join(
    f"{x} binary" for x in (*_SIDES, "a_ends", "b_ends"))


def _encoded(docs: DataFrame, files: Vocabularies, steps: int) -> DataFrame:
    """Rows (doc_id, text) as pieces. The only piece of a text is merged; others hold byte ends."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        side_a = encoder(files.a, plain=True, remembered=REMEMBERED_WORDS)
        side_b = _piece_encoder(files.b)
        a_size = _byte_level_sizes(files.a)
        b_size = np.array([len(x) for x in side_b.bytes_of], dtype=np.int32)
        gc.freeze()  # the memories are large, and nothing in them is cyclic
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                part = whole.slice(at, ROWS_AT_ONCE)
                texts = [x or "" for x in part.column(1).to_pylist()]
                out: list[tuple] = []
                for doc, text, x, y in zip(part.column(0).to_pylist(), texts,
                                           side_a.encode([f" {x}" for x in texts]), side_b.encode(texts)):
                    a = np.frombuffer(x, dtype="<i4")
                    b = np.frombuffer(y or b"", dtype="<i4")
                    ends_a, ends_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
                    row += 1
                    # A vocabulary of all bytes spells a text exactly, or drops bytes of it.
                    if not text or y is None or not len(a) or ends_a[-1] != len(text.encode()) + 1:
                        out.append((doc, task, row, 0, 1, *[_NONE] * 6))
                    elif len(a) + len(b) <= steps:
                        sizes = _merged(ends_a, ends_b)
                        out.append((doc, task, row, 0, 1, a, b, sizes[0][:-1], sizes[1][:-1], _NONE, _NONE))
                    else:
                        i, j = diagonal_cuts(ends_a, ends_b, steps)
                        out += [(doc, task, row, k, len(i) - 1, a[p:q], b[r:s], _NONE, _NONE,
                                 ends_a[p:q], ends_b[r:s])
                                for k, (p, q, r, s) in enumerate(zip(i, i[1:], j, j[1:]))]
                yield _pieces(out)

    return docs.mapInArrow(encoded, _PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, kinds)] + [_lists(list(c)) for c in columns[5:]],
        names)


def _values(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<i4") for x in batch.column(name).to_pylist()]


def _piecewise(pieces: DataFrame) -> DataFrame:
    """Merges each piece by itself: its groups' sizes, with its open rest as the last ones."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_merged(a, b) for a, b in zip(_values(batch, "a_ends"), _values(batch, "b_ends"))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:7], _lists([x for x, _ in sizes]), _lists([x for _, x in sizes])],
                batch.schema.names[:9])

    return pieces.mapInArrow(merged, _PIECES.partition(", a_ends")[0])


def _stitched(pieces: DataFrame, tasks: int) -> DataFrame:
    """Texts of several merged pieces: what a piece leaves open begins the next piece's first group."""
    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            columns = {x: _values(batch, x) for x in _SIDES}
            for k, (doc, piece, pieces_) in enumerate(zip(*(
                    batch.column(x).to_pylist() for x in ("doc_id", "piece", "pieces")))):
                if piece == 0:
                    held = {x: [] for x in _SIDES}
                for x in _SIDES:
                    found = columns[x][k].copy()
                    if x.endswith("sizes") and held[x]:
                        found[0] += held[x][-1][-1]
                        held[x][-1] = held[x][-1][:-1]
                    held[x].append(found)
                if piece == pieces_ - 1:
                    sides = {x: np.concatenate(held[x]) for x in _SIDES}
                    # Both sides end with the text, so nothing is left open behind the last piece.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc], type=pa.int64()), *(_lists([
                            sides[x][:-1] if x.endswith("sizes") else sides[x]]) for x in _SIDES)],
                        ["doc_id", *_SIDES])

    return (pieces.repartition(tasks, "task", "row")
            .sortWithinPartitions("task", "row", "piece").mapInArrow(stitched, ALIGNED))


def align(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text",
          steps: int = STEPS) -> DataFrame:
    """Both token sequences of every text and their groups: doc_id, a_ids, b_ids (token ids),
    a_sizes and b_sizes (tokens of either side in each group, in order), each packed as
    little-endian 32-bit integers; ``unpacked`` makes arrays of them.

    Texts are read after a blank: A gets it in the text, B adds it. Names of special tokens inside a
    text are ordinary text. A text that is null or empty, or that one side does not spell byte for
    byte, has empty lists. Every row gives one row, whatever its id; rows that repeat stay, other
    columns are left out, and an empty table gives an empty one. ``steps`` is the work of a piece.
    The result is stored in the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        pieces = stored(_encoded(rows, files, steps), "token-pieces", **_ROW_GROUP)
        tasks = spread(pieces)
        whole = pieces.where("pieces = 1").select("doc_id", *_SIDES)
        dealt = pieces.where("pieces > 1").repartition(tasks, "task", "row", "piece")
        return whole.unionByName(stored(_stitched(_piecewise(dealt), tasks), "stitched-texts"))


def unpacked(aligned: DataFrame) -> DataFrame:
    """Aligned rows with arrays in place of packed lists."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(_values(batch, x), type=pa.list_(pa.int32()))
                                           for x in _SIDES)], batch.schema.names)

    return aligned.select("doc_id", *_SIDES).mapInArrow(made, ALIGNED.replace("binary", "array<int>"))


def _lengths(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.binary_length(batch.column(name)).to_numpy().astype(np.int64) // 4


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _flat(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of aligned rows one after the other, and where each row's groups end."""
    out = {x: np.frombuffer(b"".join(batch.column(x).to_pylist()), dtype="<i4").astype(np.int64)
           for x in _SIDES}
    out["ends"] = np.cumsum(_lengths(batch, "a_sizes"))
    return out


def _linked(flat: dict[str, np.ndarray]) -> np.ndarray:
    """The pair of ids that ends each group, A's in the upper half."""
    return (flat["a_ids"][np.cumsum(flat["a_sizes"]) - 1] << 32
            | flat["b_ids"][np.cumsum(flat["b_sizes"]) - 1])


def link_counts(aligned: DataFrame) -> DataFrame:
    """How often tokens of either side end at the same byte: a_id, b_id, n, and best (whether no
    other A id is linked more often to this B id).

    The bytes of one of two linked tokens end with the other's, so there are at most as many pairs
    as the bytes of both vocabularies together, whatever the corpus; tasks sum them before they are
    exchanged.
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in _small(batches):
            some, k = np.unique(_linked(_flat(batch)), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, some]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n, k]), len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["a_id", "b_id", "n"])

    sums = aligned.select(*_SIDES).mapInArrow(counted, "a_id bigint, b_id bigint, n bigint") \
        .groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


@lru_cache(maxsize=1)
def _names(size: int) -> np.ndarray:
    """Each id below ``size`` in decimal, followed by a mark, as rows of bytes ending in zeros: all
    with a comma, then all with a bar, then all with a semicolon. Made once for a worker, as making
    it takes as long as writing the groups of many rows."""
    names = np.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], dtype=f"S{len(str(size)) + 1}")
    return names.view(np.uint8).reshape(3 * size, -1)


def written_groups(flat: dict[str, np.ndarray], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Groups as text (``a1,a2|b1;``), some at a time: first and last group, bytes, and how many
    bytes each of these groups takes."""
    table = _names(size)
    a_ends, b_ends = np.cumsum(flat["a_sizes"]), np.cumsum(flat["b_sizes"])
    first = 0
    while first < len(a_ends):
        a0, b0 = (int(a_ends[first - 1]), int(b_ends[first - 1])) if first else (0, 0)
        last = max(first + 1, int(np.searchsorted(a_ends + b_ends, a0 + b0 + TOKENS_AT_ONCE)))
        a_sizes, b_sizes = flat["a_sizes"][first:last], flat["b_sizes"][first:last]
        a1, b1 = int(a_ends[last - 1]), int(b_ends[last - 1])
        a_name, b_name = flat["a_ids"][a0:a1].copy(), flat["b_ids"][b0:b1].copy()
        a_name[np.cumsum(a_sizes) - 1] += size
        b_name[np.cumsum(b_sizes) - 1] += 2 * size
        order = np.empty(a1 - a0 + b1 - b0, dtype=np.int64)
        order[np.arange(a1 - a0) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = a_name
        order[np.arange(b1 - b0) + np.repeat(np.cumsum(a_sizes), b_sizes)] = b_name
        marks = table[order]
        some = marks != 0
        begins = np.cumsum(a_sizes + b_sizes) - a_sizes - b_sizes
        yield first, last, marks[some], np.add.reduceat(some.sum(axis=1), begins)
        first = last


def digests(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each aligned row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256, the SHA-256 of its groups as text (empty without tokens).

    Two tokens of one side never end at the same byte, so each group holds one link, its last pair.
    ``counts`` is bounded by the vocabularies (see ``link_counts``) and goes to every task. The
    result is stored in the shared folder.
    """
    spark = aligned.sparkSession
    with small_batches(spark):
        table = counts.select("a_id", "b_id", "n", "best").toArrow()
    key, n, best = ((table["a_id"].to_numpy() << 32) | table["b_id"].to_numpy(),
                    table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False))
    order = np.argsort(key)
    size = int(max((key >> 32).max(initial=0), (key & 0xFFFFFFFF).max(initial=0))) + 1
    known = spark.sparkContext.broadcast((key[order], n[order], best[order]))
    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in (
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")) + ", groups_sha256 string"

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        keys, n, best = known.value
        for batch in _small(batches):
            flat = _flat(batch)
            at = np.searchsorted(keys, _linked(flat))
            ends = flat["ends"]
            width = max(size, *(int(flat[x].max(initial=0)) + 1 for x in ("a_ids", "b_ids")))
            width += -width % 4096  # so that batches share a table of names

            def total(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values)])
                return np.diff(sums[ends], prepend=0)

            groups = np.diff(ends, prepend=0)
            hashes = [hashlib.sha256() if k else None for k in groups]
            for first, last, text, taken in written_groups(flat, width):
                data, stops = text.tobytes(), np.concatenate([[0], np.cumsum(taken)])
                at_group = first
                while at_group < last:
                    row = int(np.searchsorted(ends, at_group, side="right"))
                    stop = min(last, int(ends[row]))
                    # The mark behind a text's last group is left out.
                    hashes[row].update(
                        data[stops[at_group - first]:stops[stop - first] - (stop == ends[row])])
                    at_group = stop
            lengths = [_lengths(batch, x) for x in ("a_ids", "b_ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (
                    *lengths, groups, groups, total(best[at].astype(np.int64)), total(n[at]))),
                 pa.array([x.hexdigest() if x else "" for x in hashes])],
                [x.split()[0] for x in schema.split(", ")])

    with small_batches(spark):
        return stored(aligned.mapInArrow(digested, schema), "alignment-digests")
