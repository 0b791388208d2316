"""Ranked lexical search of stated items in a corpus, by a dual-tree search.

A document's score for an item is a sum over terms of the term's weight in the item and the term's
impact in the document, so both are vectors with coordinates that are never negative. A hierarchy
over items and one over documents hold, in each node, the greatest value of each coordinate below
it. The product of two nodes bounds every score of their items and documents; where it lies below
the least k-th best score that the node's items have so far, the whole pair is dropped. Both
hierarchies are descended together, and documents that no bound rules out are scored exactly.

Documents meet in order of the term that can give them most, so a node's documents share their
rare terms. Each task builds trees over runs of ``tree`` of its documents. The k-th best scores of
a share of all documents, searched first, are where every task starts; they only save work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendlake.functions.keys import numbered
from lendlake.llm.shared import row_hash, spread, stored

ROWS_AT_ONCE = 500
# Of all byte values, those a term may hold: digits, letters (lower-cased) and all beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


@dataclass(frozen=True)
class Search:
    """``k`` documents an item. ``leaf`` documents and ``item_leaf`` items of a lowest node,
    children of a node above, documents of a tree. Items are searched in groups of at most
    ``items`` items and ``entries`` terms (or one item), and read in passes of ``pass_entries``
    terms (or one item), the bound of what is broadcast. ``first``: one in so many documents is
    searched first."""

    k: int = 20
    leaf: int = 16
    item_leaf: int = 4
    fanout: int = 4
    tree: int = 4096
    items: int = 256
    entries: int = 1 << 15
    pass_entries: int = 1 << 20
    first: int = 32


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order; none of null."""
    return (text or "").encode().translate(_TERM_BYTES).split()


@dataclass
class Entries:
    """A sparse matrix: for each row its coordinates, ascending, and their values."""

    bounds: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def grouped(self, size: int) -> Entries:
        """Runs of ``size`` rows as one row each, with the greatest value of each coordinate."""
        row = np.repeat(np.arange(len(self.bounds) - 1) // size, np.diff(self.bounds))
        order = np.lexsort((self.columns, row))
        row, columns = row[order], self.columns[order]
        new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(columns, prepend=-1))
        values = np.maximum.reduceat(self.values[order], new) if len(new) else self.values
        rows = -(-(len(self.bounds) - 1) // size)
        return Entries(np.searchsorted(row[new], np.arange(rows + 1)), columns[new], values)

    def products(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """The product of each of some rows with a vector over the coordinates."""
        n = self.bounds[rows + 1] - self.bounds[rows]
        at = np.repeat(self.bounds[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.concatenate([[0], np.cumsum(vector[self.columns[at]] * self.values[at])])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]


@dataclass
class Group:
    """Items searched together: their numbers, in an order that brings alike ones together; the
    terms they hold; and the levels of their hierarchy from the items up to one root, as rows of
    coordinate maxima."""

    numbers: np.ndarray
    terms: np.ndarray
    levels: list[np.ndarray] = field(default_factory=list)


def _alike(vectors: np.ndarray, size: int) -> list[int]:
    """An order of rows in which alike ones are near: halves by two unlike rows, again and again."""
    def halved(rows: np.ndarray) -> list[int]:
        if len(rows) <= size:
            return rows.tolist()
        one = int(np.argmin(vectors[rows] @ vectors[rows[0]]))
        other = int(np.argmin(vectors[rows] @ vectors[rows[one]]))
        lean = vectors[rows] @ (vectors[rows[one]] - vectors[rows[other]])
        order = rows[np.argsort(-lean, kind="stable")]
        return halved(order[:len(rows) // 2]) + halved(order[len(rows) // 2:])

    return halved(np.arange(len(vectors)))


def item_groups(items: list[tuple[int, dict[int, int]]], weights: np.ndarray, search: Search
                ) -> list[Group]:
    """The items (number, and how often it has each term) in groups with their hierarchies."""
    groups, held, size = [], [], 0
    for item in [*items, None]:
        if held and (item is None or len(held) == search.items or size + len(item[1]) > search.entries):
            terms = np.array(sorted(set().union(*(t for _, t in held))), dtype=np.int64)
            dense = np.zeros((len(held), len(terms)), dtype=np.int64)
            for row, (_, counts) in zip(dense, held):
                row[np.searchsorted(terms, list(counts))] = weights[list(counts)] * list(counts.values())
            length = np.sqrt((dense.astype(float) ** 2).sum(axis=1, keepdims=True))
            order = _alike(dense / np.maximum(length, 1), search.item_leaf)
            group = Group(np.array([held[i][0] for i in order]), terms, [dense[order]])
            step = search.item_leaf
            while len(group.levels[-1]) > 1:
                below = group.levels[-1]
                group.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), step)))
                step = search.fanout
            groups.append(group)
            held, size = [], 0
        if item is not None:
            held.append(item)
            size += len(item[1])
    return groups


def _children(pairs: np.ndarray, side: int, step: int, n: int) -> np.ndarray:
    """Pairs of nodes with the node on one side replaced by each of its children."""
    out = np.repeat(pairs, step, axis=0)
    out[:, side] = out[:, side] * step + np.tile(np.arange(step), len(pairs))
    return out[out[:, side] < n]


def dual_tree(docs: Entries, group: Group, least: np.ndarray, search: Search
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item (its place in the group), row of ``docs`` and score of all pairs whose score is above
    zero and at least the item's ``least``, except none that could be among its best."""
    # The coordinates of the group alone.
    at = np.minimum(np.searchsorted(group.terms, docs.columns), len(group.terms) - 1)
    mine = group.terms[at] == docs.columns
    counts = np.concatenate([[0], np.cumsum(mine)])
    levels = [Entries(counts[docs.bounds], at[mine], docs.values[mine])]
    steps, item_steps = [search.leaf], [search.item_leaf]
    while len(levels[-1].bounds) > 2:
        levels.append(levels[-1].grouped(steps[-1]))
        steps.append(search.fanout)
    floors = [least]
    while len(floors) < len(group.levels):
        floors.append(np.minimum.reduceat(floors[-1], np.arange(0, len(floors[-1]), item_steps[-1])))
        item_steps.append(search.fanout)
    i, d = len(group.levels) - 1, len(levels) - 1
    pairs = np.zeros((1, 2), dtype=np.int64)

    def kept(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        bound = np.zeros(len(pairs), dtype=np.int64)
        nodes, begins = np.unique(pairs[:, 0], return_index=True)
        for node, a, b in zip(nodes, begins, [*begins[1:], len(pairs)]):
            bound[a:b] = levels[d].products(pairs[a:b, 1], group.levels[i][node])
        good = (bound > 0) & (bound >= floors[i][pairs[:, 0]])
        return pairs[good], bound[good]

    pairs, bound = kept(pairs)
    while (i or d) and len(pairs):
        # The side with more levels left goes down, so both arrive at their leaves together.
        if d >= i:
            d -= 1
            pairs, bound = kept(_children(pairs, 1, steps[d], len(levels[d].bounds) - 1))
        else:
            i -= 1
            pairs, bound = kept(_children(pairs, 0, item_steps[i], len(group.levels[i])))
    return pairs[:, 0], pairs[:, 1], bound


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best of each item: columns item, score, whether the id is null, id, tie."""
    item, score, null, doc, tie = found
    order = np.lexsort((tie, doc, null, -score, item))
    item = item[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return [x[order[place < k]] for x in found]


_FOUND = "item bigint, score bigint, doc_id bigint, tie bigint"


def _searched(docs: DataFrame, groups, floors, search: Search) -> DataFrame:
    """Each task's best documents of every item; rows doc_id, tie, terms, impacts. ``groups`` and
    ``floors`` (least scores by item number) are broadcast."""
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floors.value.copy()
        best = [np.zeros(0, np.int64) for _ in range(5)]
        for rows in _runs(batches, search.tree):
            null = rows.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = rows.column("doc_id").fill_null(0).to_numpy()
            tie = rows.column("tie").to_numpy()
            terms = rows.column("terms").combine_chunks()
            impacts = rows.column("impacts").combine_chunks()
            ends = np.concatenate([[0], np.cumsum(np.diff(terms.offsets.to_numpy()))])
            entries = Entries(ends, terms.flatten().to_numpy().astype(np.int64),
                              impacts.flatten().to_numpy())
            for group in groups.value:
                item, row, score = dual_tree(entries, group, least[group.numbers], search)
                new = [group.numbers[item], score, null[row], ids[row], tie[row]]
                best = _best([np.concatenate(x) for x in zip(best, new)], search.k)
                item, first, n = np.unique(best[0], return_index=True, return_counts=True)
                full = n == search.k
                worst = best[1][first[full] + search.k - 1]
                least[item[full]] = np.maximum(least[item[full]], worst)
        item, score, null, doc, tie = best
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(score), pa.array(doc, mask=null.astype(bool)), pa.array(tie)],
            ["item", "score", "doc_id", "tie"])

    return docs.select("doc_id", "tie", "terms", "impacts").mapInArrow(searched, _FOUND)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``size`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while n + batch.num_rows >= size:
            yield pa.Table.from_batches([*held, batch.slice(0, size - n)])
            batch, held, n = batch.slice(size - n), [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def _counted(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows (doc_id, tie, text) as doc_id, tie, n (terms), and how often the document has each term
    of the broadcast ``vocabulary`` that it holds: terms and counts."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, size = vocabulary.value.get, max(1, len(vocabulary.value))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                n, keys = [], [np.zeros(0, dtype=np.int64)]
                for row, text in enumerate(batch.column(2).to_pylist()):
                    terms = terms_of(text)
                    n.append(len(terms))
                    known = [t for t in map(find, terms) if t is not None]
                    keys.append(np.array(known, dtype=np.int64) + row * size)
                key, times = np.unique(np.concatenate(keys), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, type=pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array((key % size).astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))],
                    ["doc_id", "tie", "n", "terms", "counts"])

    return docs.mapInArrow(
        counted, "doc_id bigint, tie bigint, n bigint, terms array<int>, counts array<int>")


def _weighed(docs: DataFrame, most) -> DataFrame:
    """Rows (doc_id, tie, m, terms, counts) with impacts, and the term that can give the document
    most with what it can give (lead, gain). ``most``: the greatest weight of a term in an item."""
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = batch.column("terms"), batch.column("counts")
            n = np.diff(terms.offsets.to_numpy())
            tf = counts.flatten().to_numpy().astype(np.int64)
            term = terms.flatten().to_numpy()
            m = np.repeat(batch.column("m").to_numpy(), n)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
            gain = impact * most.value[term]
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((-gain, row))
            first = order[np.cumsum(n) - n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), terms,
                 pa.ListArray.from_arrays(terms.offsets, pa.array(impact)),
                 pa.array(term[first]), pa.array(gain[first])],
                ["doc_id", "tie", "terms", "impacts", "lead", "gain"])

    return docs.mapInArrow(weighed, "doc_id bigint, tie bigint, terms array<int>, "
                                    "impacts array<bigint>, lead int, gain bigint")


def _passes(items: DataFrame, search: Search) -> tuple[DataFrame, int]:
    """Items with their number and the pass they are searched in, and how many passes there are."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [terms_of(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(terms, type=pa.list_(pa.binary()))],
                ["item_id", "tie", "terms"])

    read = items.mapInArrow(made, "item_id bigint, tie bigint, terms array<binary>")
    placed = numbered(read, ["item_id", "tie", "terms"], "item")
    placed = stored(numbered(placed, ["item"], "before", F.size("terms")).withColumn(
        "pass", F.expr(f"before div {search.pass_entries}")), "items")
    last = placed.agg(F.max("pass")).first()[0]
    return placed, 0 if last is None else last + 1


def rank_documents(docs: DataFrame, items: DataFrame, search: Search = Search(),
                   id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame:
    """The documents that score highest for each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of digits, letters and characters beyond ASCII, with A to Z lower-cased. With N
    documents that have a term, L terms in all, n of them in a document, df documents holding a
    term: a term weighs floor(1000 ln((2N+2)/(2df+1))), a document's length counts as
    m = 75 + 25nN div L, and tf occurrences have the impact 1000000000tf div (1000tf+12m). Only
    scores above zero count. Equal scores come by ascending id, a null id last, then by row hash.

    A null or empty text has no terms; such an item has no rows. Rows that repeat stay on both
    sides: each document row ranks by itself, each item row has ranks of its own. Other columns play
    no part. An empty table on either side gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row_hash(docs).alias("tie"),
                       F.col(text_col).alias("text"))
    numbered_items, passes = _passes(items.select(
        F.col(item_col).cast("bigint").alias("item_id"), row_hash(items).alias("tie"),
        F.col(item_text_col).alias("text")), search)
    out = spark.createDataFrame([], _FOUND)
    for at in range(passes):
        # At most ``pass_entries`` terms and those of one item more.
        some = [(r.item, r.terms) for r in numbered_items.where(F.col("pass") == at)
                .select("item", "terms").orderBy("item").collect()]
        out = out.unionByName(_searched_pass(rows, some, search))
    order = Window.partitionBy("item").orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id"), "tie")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)
    return best.join(numbered_items.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score")


def _searched_pass(rows: DataFrame, items: list[tuple[int, list[bytes]]], search: Search) -> DataFrame:
    context = rows.sparkSession.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(t) for _, terms in items for t in terms}))}
    found = stored(_counted(rows, context.broadcast(vocabulary)), "term-counts")
    some = found.where(F.size("terms") > 0)
    size, total = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the pass.
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in some.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * size + 2) / (2 * x + 1))) for x in df.tolist()],
                       dtype=np.int64)
    counts = []
    base = items[0][0] if items else 0
    for number, terms in items:
        times: dict[int, int] = {}
        for t in terms:
            times[vocabulary[bytes(t)]] = times.get(vocabulary[bytes(t)], 0) + 1
        if times:
            counts.append((number - base, times))
    most = np.zeros(len(vocabulary), dtype=np.int64)
    for _, times in counts:
        for t, n in times.items():
            most[t] = max(most[t], n * int(weights[t]))
    groups = context.broadcast(item_groups(counts, weights, search))
    floors = np.zeros(items[-1][0] - base + 1 if items else 0, dtype=np.int64)
    measured = some.select("doc_id", "tie", "terms", "counts", F.expr(
        f"75 + (25 * n * {size}L) div {max(1, total)}L").alias("m"))
    weighed = _weighed(measured, context.broadcast(most))
    first = weighed.where(F.pmod(F.xxhash64("tie"), F.lit(search.first)) == 0)
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    for item, score in _searched(first, groups, context.broadcast(floors), search).withColumn(
            "place", F.row_number().over(order)).where(F.col("place") == search.k) \
            .select("item", "score").collect():
        floors[item] = score
    dealt = weighed.repartitionByRange(spread(rows), "lead", "tie").sortWithinPartitions(
        "lead", F.desc("gain"))
    return _searched(dealt, groups, context.broadcast(floors), search).withColumn(
        "item", F.col("item") + base)
