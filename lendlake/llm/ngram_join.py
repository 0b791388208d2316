"""Similarity join on word n-grams by chosen paths.

Texts become sets of five-word shingles; texts with the same set are one node. A node follows paths:
at each step of a path one or two coordinates of its minhash signature are sampled, by a hash of the
path alone, and the values there name the buckets it enters next. On average 1 / threshold
coordinates are sampled, so two sets at the threshold are expected to stay together at every step,
while unlike sets part. Buckets of at most ``brute_force`` nodes are compared in full. A larger one
is split again, unless it holds most of the bucket it came from: then its nodes are alike, no path
would part them, and it is compared in full in blocks. No bucket is dropped or cut.

Runs are repeated until the last quarter of them finds less than 1 - ``recall`` of the links. A
pair may meet in many buckets; it counts in the least one both are in, which each node's list of
buckets tells. So links are counted without ever listing pairs. Candidates are told by signatures;
links are pairs whose exact Jaccard similarity reaches the threshold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.components import connected, roots
from lendlake.llm.shared import prefix, small_batches, spread, stored, text_of

COORDINATES = 128
ROWS_AT_ONCE = 400
PAIRS_AT_ONCE = 100_000
# A table of at most so many nodes, counted first, is small enough to broadcast.
BROADCAST_NODES = 200_000
# One coordinate always, a second one in one of four steps: 1.25 on average, for 0.8.
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Join:
    """``brute_force``: nodes of a bucket that is compared at once. ``candidate``: share of equal
    signature values at which a pair is verified; five deviations below the threshold. ``dense``:
    share of its parent at which a bucket is taken to hold like nodes."""

    words: int = 5
    threshold: float = 0.8
    recall: float = 0.99
    runs: int = 16
    brute_force: int = 512
    candidate: float = 0.62
    dense: float = 0.6
    depth: int = 16


def _mix(x: np.ndarray | np.uint64) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MULTIPLY = _mix(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64)) | _ONE
_ADD = _mix(np.arange(2000, 2000 + COORDINATES, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[_ONE], np.full(n, base)]).astype(np.uint64))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of lower-cased UTF-8 texts, ascending in each text, and where
    each text's begin (one more bound at the end).

    Words are runs of ASCII letters, digits and characters beyond ASCII. A text of fewer words than
    a shingle, but of one at least, is one shingle. Hashes of words are differences of running
    polynomial sums, so all words of a batch are hashed at once.
    """
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", dtype=np.uint8)
    inside = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * _powers(_FACTOR, len(data) - 1))])
        hashes = _mix((sums[ends] - sums[begins]) * _powers(_INVERSE, len(data))[begins])
        first = np.searchsorted(begins, bounds[:-1])
        last = np.searchsorted(begins, bounds[1:])
        n = last - first
        made = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
        for i in range(words):
            made = _mix(made * _FACTOR + hashes[i:i + len(made)] + _ONE)
    out, counts = [], np.zeros(len(texts), dtype=np.int64)
    for i, (a, k) in enumerate(zip(first, n)):
        if k >= words:
            found = np.unique(made[a:a + k - words + 1])
        elif k:
            short = np.uint64(k)
            for h in hashes[a:a + k]:
                with np.errstate(over="ignore"):
                    short = _mix(short * _FACTOR + h + _ONE)
            found = np.array([short], dtype=np.uint64)
        else:
            found = np.zeros(0, dtype=np.uint64)
        counts[i] = len(found)
        out.append(found)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The minhash signature of each (non-empty) set, a row of 32-bit values."""
    out = np.empty((len(bounds) - 1, COORDINATES), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            seen = ((values * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32)
            out[:, i] = np.minimum.reduceat(seen, bounds[:-1])
    return out


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set: sums of two hashes of its members."""
    with np.errstate(over="ignore"):
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(_mix(values ^ seed))])
                for seed in (_BYTE[7], _BYTE[11])]
        both = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
    return [x.tobytes() for x in both]


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _featured(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, tie, node, n (shingles) and sig of rows (doc_id, tie, text); without words: null."""
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                values, bounds = shingles(_utf8(batch.column(2)), words)
                n = np.diff(bounds)
                some = n > 0
                kept = np.concatenate([[0], np.cumsum(n[some])])
                sig = iter(signatures(values, kept)) if some.any() else iter(())
                node = iter(fingerprints(values, kept))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1),
                     pa.array([next(node) if x else None for x in some], type=pa.binary()),
                     pa.array(n), pa.array([next(sig).tobytes() if x else None for x in some],
                                           type=pa.binary())],
                    ["doc_id", "tie", "node", "n", "sig"])

    return rows.mapInArrow(featured, "doc_id bigint, tie bigint, node binary, n bigint, sig binary")


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _coordinates(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates a step takes, and whether it takes the second; from the path alone."""
    first = (_mix(path + _BYTE[1]) % np.uint64(COORDINATES)).astype(np.int64)
    step = (_mix(path + _BYTE[2]) % np.uint64(COORDINATES - 1)).astype(np.int64)
    return first, (first + 1 + step) % COORDINATES, (_mix(path + _BYTE[3]) & np.uint64(3)) == 0


def _entered(path: np.ndarray, coordinate: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(_mix(path + coordinate.astype(np.uint64)) ^ (value.astype(np.uint64) * _FACTOR))


def _steps(sig: np.ndarray, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the paths they continue on."""
    first, second, takes = _coordinates(path)
    rows = np.arange(len(path))
    one = _entered(path, first, sig[rows, first])
    two = _entered(path[takes], second[takes], sig[rows[takes], second[takes]])
    return np.concatenate([rows, rows[takes]]), np.concatenate([one, two])


def _begun(nodes: DataFrame, runs: range) -> DataFrame:
    """The first step of every run: run, path, node."""
    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1), np.uint32, COORDINATES)
            for run in runs:
                root = np.full(len(sig), _mix(np.uint64(run) + _BYTE[0]))
                at, path = _steps(sig, root)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), run, dtype=np.int32)), pa.array(path.view(np.int64)),
                     batch.column(0).take(pa.array(at))], ["run", "path", "node"])

    return nodes.select("node", "sig").mapInArrow(begun, "run int, path bigint, node binary")


def _continued(rows: DataFrame) -> DataFrame:
    """The next step of rows (run, path, parent, node, sig)."""
    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(4), np.uint32, COORDINATES)
            at, path = _steps(sig, batch.column(1).to_numpy().view(np.uint64))
            taken = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), pa.array(path.view(np.int64)),
                 batch.column(2).take(taken), batch.column(3).take(taken)],
                ["run", "path", "parent", "node"])

    return rows.select("run", "path", "parent", "node", "sig").mapInArrow(
        continued, "run int, path bigint, parent bigint, node binary")


def _leaves(nodes: DataFrame, runs: range, join: Join) -> DataFrame:
    """The buckets of these runs that are compared in full: leaf, node, blocks."""
    total = nodes.count()
    level = _begun(nodes, runs).withColumn("parent", F.lit(total).cast("bigint"))
    found = None
    for depth in range(1, join.depth + 1):
        level = stored(level, "paths")
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        met = level.join(sizes, "path")
        dense = F.lit(depth == join.depth) | (F.col("size") >= join.dense * F.col("parent"))
        ends = (F.col("size") <= join.brute_force) | dense
        leaf = F.shiftleft(F.col("run").cast("bigint"), 48).bitwiseOR(
            F.shiftrightunsigned("path", 16))
        met = stored(met.withColumn("ends", ends).withColumn("leaf", leaf), "buckets")
        here = met.where("ends").select("leaf", "node", F.ceil(
            F.col("size") / join.brute_force).cast("int").alias("blocks"))
        found = here if found is None else found.unionByName(here)
        goes_on = met.where("not ends").select("run", "path", F.col("size").alias("parent"), "node")
        n = goes_on.count()
        if not n:
            break
        goes_on = F.broadcast(goes_on) if n <= BROADCAST_NODES else goes_on
        level = _continued(nodes.select("node", "sig").join(goes_on, "node"))
    return found


def _cells(leaves: DataFrame) -> DataFrame:
    """Leaves as cells to compare: a cell is a leaf, or two blocks of a leaf in blocks."""
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.lit(0))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)
    return leaves.withColumn("block", block.cast("bigint")).withColumn(
        "other", F.explode(others)).withColumn(
        "cell", F.xxhash64("leaf", F.least("block", "other"), F.greatest("block", "other"))).select(
        "cell", "leaf", F.when(F.col("blocks") > 1, F.col("block")).otherwise(F.lit(-1)).alias("block"),
        F.when(F.col("blocks") > 1, F.col("other")).otherwise(F.lit(-1)).alias("other"), "node")


def _by_cell(rows: DataFrame, work: Callable[[pa.Table], list[pa.RecordBatch]], schema: str,
             rows_at_once: int, tasks: int) -> DataFrame:
    """``work`` on tables of whole cells; column 0 is the cell. A cell is bounded, so is a table."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows_at_once:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cells = table.column(0).to_numpy()
            cut = int(np.searchsorted(cells, cells[-1]))
            if cut:
                yield from work(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            n = len(cells) - cut
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(whole, schema)


def _pairs(cells: np.ndarray, block: np.ndarray, other: np.ndarray
           ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that one cell compares, some at a time: all pairs of the cell, or those across
    its two blocks."""
    begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    ends = np.concatenate([begins[1:], [len(cells)]])
    # Row i meets the rows after it in its cell.
    after = np.repeat(ends, ends - begins) - np.arange(len(cells)) - 1
    begun = 0
    sums = np.cumsum(after)
    while begun < len(cells):
        stop = int(np.searchsorted(sums, (sums[begun - 1] if begun else 0) + PAIRS_AT_ONCE)) + 1
        stop = min(max(stop, begun + 1), len(cells))
        n = after[begun:stop]
        left = np.repeat(np.arange(begun, stop), n)
        shift = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = left + 1 + shift
        across = (block[left] == other[right]) & (other[left] == block[right])
        yield left[across], right[across]
        begun = stop


def _padded(lists: pa.ListArray) -> np.ndarray:
    """Lists of buckets as rows of a matrix, filled with values that equal nothing."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    n = np.diff(ends)
    out = -np.arange(1, 1 + len(n))[:, None] * np.ones(n.max(initial=1), dtype=np.int64)[None, :]
    at = np.arange(out.shape[1])[None, :] < n[:, None]
    out[at] = values
    return out


def _first_meeting(lists: np.ndarray, leaf: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether no bucket before this one holds both rows of a pair."""
    out = np.ones(len(i), dtype=bool)
    step = max(1, 4_000_000 // lists.shape[1] ** 2)
    for at in range(0, len(i), step):
        a, b = lists[i[at:at + step]], lists[j[at:at + step]]
        a = np.where(a < leaf[i[at:at + step]][:, None], a, np.int64(-1) << np.int64(62))
        out[at:at + step] = ~(a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
    return out


def _candidates(rows: DataFrame, join: Join, tasks: int) -> DataFrame:
    """Rows (cell, leaf, block, other, node, sig, leaves) that may have a link in their cell."""
    def work(table: pa.Table) -> list[pa.RecordBatch]:
        cells, leaf, block, other = (table.column(i).to_numpy() for i in range(4))
        sig = _matrix(table.column(5), np.uint8, COORDINATES)
        lists = _padded(table.column(6))
        hit = np.zeros(len(cells), dtype=bool)
        for i, j in _pairs(cells, block, other):
            near = (sig[i] == sig[j]).sum(axis=1, dtype=np.int32) >= join.candidate * COORDINATES
            i, j = i[near], j[near]
            first = _first_meeting(lists, leaf, i, j)
            hit[i[first]] = hit[j[first]] = True
        return table.select([0, 1, 2, 3, 4]).filter(pa.array(hit)).to_batches()

    return _by_cell(rows.select("cell", "leaf", "block", "other", "node", "sig", "leaves"), work,
                    "cell bigint, leaf bigint, block bigint, other bigint, node binary", 20_000, tasks)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = n > 1
    place = np.cumsum(several) - 1
    owner, column = owner[several[column]], place[column[several[column]]]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(256, 4_000_000 // len(sets))
    for at in range(0, int(several.sum()), width):
        mine = (column >= at) & (column < at + width)
        members = np.zeros((len(sets), width), dtype=np.float32)
        members[owner[mine], column[mine] - at] = 1
        out += members @ members.T
    return out


def _verified(rows: DataFrame, join: Join, tasks: int) -> DataFrame:
    """Links that first meet here: node, links (documents linked), run, root (of its component in
    this cell). Rows: cell, leaf, block, other, node, leaves, copies, set."""
    def work(table: pa.Table) -> list[pa.RecordBatch]:
        cells, leaf, block, other = (table.column(i).to_numpy() for i in range(4))
        nodes, copies = table.column(4).to_pylist(), table.column(6).to_numpy()
        lists, sets = _padded(table.column(5)), table.column(7).combine_chunks()
        ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
        size = np.diff(ends)
        begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        out: list[tuple] = []
        for a, b in zip(begins, [*begins[1:], len(cells)]):
            shared = _shared_counts([values[ends[k]:ends[k + 1]] for k in range(a, b)])
            either = size[a:b, None] + size[None, a:b] - shared
            linked = np.triu(shared >= join.threshold * either - 1e-9, 1)
            linked &= (block[a:b, None] == other[None, a:b]) & (other[a:b, None] == block[None, a:b])
            i, j = np.nonzero(linked)
            first = _first_meeting(lists, leaf, i + a, j + a)
            i, j = i[first], j[first]
            links = np.zeros(b - a, dtype=np.int64)
            np.add.at(links, i, copies[a + j])
            np.add.at(links, j, copies[a + i])
            root = roots(b - a, i, j)
            out += [(nodes[a + k], int(links[k]), int(leaf[a] >> 48), nodes[a + root[k]])
                    for k in np.flatnonzero(links)]
        if not out:
            return []
        return [pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(
                zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.binary()),
                strict=True)], ["node", "links", "run", "root"])]

    return _by_cell(rows.select("cell", "leaf", "block", "other", "node", "leaves", "copies", "set"),
                    work, "node binary, links bigint, run int, root binary", 2_000, tasks)


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """node and set (shingle hashes) of rows (text)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                values, bounds = shingles(_utf8(whole.slice(at, ROWS_AT_ONCE).column(0)), words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fingerprints(values, bounds), type=pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)),
                                              pa.array(values.view(np.int64)))], ["node", "set"])

    return texts.mapInArrow(made, "node binary, set array<bigint>")


def _joined(rows: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored features of rows (doc_id, tie, text), their nodes, and links found in enough runs."""
    featured = stored(_featured(rows, join.words), "features")
    nodes = stored(featured.where("n > 0").groupBy("node", "n", "sig").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"),
        F.min("tie").alias("tie")), "nodes")
    leaves, found = None, None
    for batch in range(1 << 12):
        runs = range(batch * join.runs, (batch + 1) * join.runs)
        new = _leaves(nodes, runs, join)
        leaves = new if leaves is None else leaves.unionByName(new)
        links = stored(_links(rows, nodes, leaves, new, join), "links")
        found = links if found is None else found.unionByName(links)
        late = (batch + 1) * join.runs - max(1, join.runs // 4)
        every, last = found.agg(F.sum("links"), F.sum(F.when(F.col("run") >= late, F.col("links")))).first()
        if (last or 0) <= (1 - join.recall) * (every or 0):
            break
    return featured, nodes, found


def similar_documents(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id and n_links.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least the
    threshold. ``n_links`` counts a document's links, copies included. Documents joined by links
    are a class; ``class_id`` is its least doc_id.

    A null or empty text, or one without words, has no shingles: it has no links and is a class of
    its own. Rows that repeat an id are documents each and, with equal texts, linked; they share the
    id. A null id is allowed: a class of null ids only has a null ``class_id``. Other columns play
    no part. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.xxhash64(id_col, text_col).alias("tie"),
                       F.lower(text_of(text_col)).alias("text"))
    with small_batches(docs.sparkSession):
        featured, nodes, found = _joined(rows, join)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.where("node <> root").select("node", F.col("root").alias("to")).distinct())
    classes = nodes.select("node", "copies", "least").join(counts, "node", "left").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = classes.where((F.col("copies") > 1) | F.col("links").isNotNull()).join(
        least, "root").select("node", "class_id", (
            F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return featured.select("doc_id", "node").join(classes, "node", "left").select(
        "doc_id", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(
            F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"))


def _links(rows: DataFrame, nodes: DataFrame, leaves: DataFrame, new: DataFrame,
           join: Join) -> DataFrame:
    """Links found in the ``new`` ones of ``leaves``."""
    lists = leaves.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    short, tasks = _short(nodes), spread(nodes)
    cells = _cells(new).join(short.join(lists, "node"), "node")
    hits = stored(_candidates(cells, join, tasks), "candidates")
    wanted = stored(hits.select("node").distinct().join(nodes.select("node", "tie", "copies"), "node")
                    .join(lists, "node"), "wanted")
    ties = wanted.select("tie").distinct()
    ties = F.broadcast(ties) if wanted.count() <= BROADCAST_NODES else ties
    sets = _sets(rows.join(ties, "tie", "left_semi").select("text"), join.words)
    # Rows that share a hash or an id may repeat a node: one of its equal sets is enough.
    one = Window.partitionBy("node").orderBy(F.size("set"))
    # One exchange by node serves the window and both joins; sets are wide, so they are not stored.
    sets = sets.withColumn("i", F.row_number().over(one)).where("i = 1").drop("i").join(
        wanted.drop("tie"), "node")
    return _verified(sets.join(hits, "node"), join, tasks)


def _short(nodes: DataFrame) -> DataFrame:
    """Signatures cut to a byte a coordinate, enough to tell candidates."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = _matrix(batch.column(1), np.uint32, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in sig], type=pa.binary())],
                ["node", "sig"])

    return nodes.select("node", "sig").mapInArrow(cut, "node binary, sig binary")


def one_of_each_class(docs: DataFrame, join: Join = Join(), id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps the document with its least id; of rows
    that share that id, the one with the least row hash. Rows with null ids stay."""
    p = prefix(docs)
    found = similar_documents(docs, join, id_col, text_col)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias(f"{p}gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col(f"{p}gone"), "left_anti").select(*docs.columns)
