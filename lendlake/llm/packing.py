"""Packing token sequences by minimum bin slack, planned on lengths alone.

Sequences hold ``capacity`` tokens, so a piece has one of ``capacity`` lengths and the whole
problem is a table of how many pieces there are of each, however many documents. The plan takes the
longest length left as the seed of a sequence, finds by subset sums on bit sets the fullest filling
from the lengths available, and uses that pattern as often as the lengths last: each pattern uses
up a length, so a plan has a bounded number of patterns.

Pieces meet the plan by length and by their number among the pieces of that length. Numbers come
from counts by hash range and numbers inside a range, so a length that a third of all pieces share
is many tasks' work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.encoding import ENCODERS, encoder
from lendlake.llm.shared import small_batches, spread, stored

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
ROWS_AT_ONCE = 500
REMEMBERED_WORDS = 900_000


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The fullest filling of a sequence that holds ``seed``, as pieces by length: subset sums as
    bits of one integer, long lengths first, so that short ones stay for later."""
    room = capacity - seed
    sums, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        for _ in range(min(counts[length] - (length == seed), room // length)):
            if sums >> room & 1:
                break
            grown = sums | (sums << length & mask)
            steps.append((length, sums))
            if grown == sums:
                steps.pop()
                break
            sums = grown
    at = sums.bit_length() - 1
    chosen = {seed: 1}
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return chosen


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns with how often each is used; all pieces are used."""
    left = {k: n for k, n in counts.items() if n}
    plan = []
    while left:
        pattern = fullest(left, max(left), capacity)
        times = min(left[k] // n for k, n in pattern.items())
        plan.append((times, pattern))
        for k, n in pattern.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return plan


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048,
              id_col: str = "doc_id", text_col: str = "text",
              remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """Encoded documents, cut where longer than ``capacity``: doc_id, piece, start, length and
    ids_crc32. All pieces of a document but the first are full. A null or empty text is the end id
    alone. ``remembered`` bounds the words a worker keeps with their ids; it changes no result."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                rows = []
                texts = encoder(vocabulary, remembered=remembered).encode(batch.column(1).to_pylist())
                for doc_id, ids in zip(batch.column(0).to_pylist(), texts, strict=True):
                    ids += end
                    n = len(ids) // 4
                    stops = [*range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip([0, *stops], stops)):
                        rows.append((doc_id, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def place_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to rows with length (1 to ``capacity``). Rows alike in all
    columns are interchangeable; nulls in other columns do not matter."""
    ranges = spread(pieces)
    names = [c for c in pieces.columns]
    rows = pieces.withColumn("_range", F.pmod(F.xxhash64(*names), F.lit(ranges)))
    sums = stored(rows.groupBy("length", "_range").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = {int(r[0]): r[1] for r in sums.groupBy("length").agg(F.sum("_n")).collect()}
    plan = plan_sequences(counts, capacity)
    first, begun = 0, dict.fromkeys(counts, 0)
    spans: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    for times, pattern in plan:
        offset = 0
        for length, n in pattern.items():
            spans[length].append((begun[length], first, n, offset))
            begun[length] += times * n
            offset += n * length
        first += times
    tables = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True))
              for k, v in spans.items()}

    before = sums.select("length", "_range", F.coalesce(F.sum("_n").over(
        Window.partitionBy("length").orderBy("_range")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(
        Window.partitionBy("length", "_range").orderBy(F.xxhash64(*names), *names))
    numbered = rows.withColumn("_in", inside).join(before, ["length", "_range"]).select(
        *names, (F.col("_before") + F.col("_in") - 1).alias("_number"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ENCODERS.clear()  # the words are not needed again, and the worker outlives this step
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy()
            numbers = batch.column(len(names)).to_numpy()
            sequence, offset = np.empty_like(numbers), np.empty_like(numbers)
            for length in np.unique(lengths):
                mine = lengths == length
                starts, firsts, n, offsets = tables[int(length)]
                at = np.searchsorted(starts, numbers[mine], side="right") - 1
                along = numbers[mine] - starts[at]
                sequence[mine] = firsts[at] + along // n[at]
                offset[mine] = offsets[at] + along % n[at] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    return numbered.mapInArrow(placed, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text",
                   remembered: int = REMEMBERED_WORDS) -> DataFrame:
    """Every document's pieces with the sequence and offset each got.

    Texts are encoded once; the table of pieces is written to the shared folder before it is
    counted. Rows that repeat an id are packed each. An empty table gives no pieces.
    """
    with small_batches(docs.sparkSession):
        pieces = stored(pieces_of(docs, vocabulary, end_id, capacity, id_col, text_col, remembered),
                        "pieces")
    return place_pieces(pieces, capacity)
