"""SimHash near duplicates through a hierarchical index in Gray order.

A text's fingerprint holds, for each of 64 bits, what most of its shingles' hashes have there.
Distinct fingerprints are sorted by their rank in the Gray code, in which neighbours differ in few
bits, and numbered; leaves are runs of ``leaf`` fingerprints, upper nodes runs of ``fanout`` nodes.
A node keeps the bits all its fingerprints share: a mask and a pattern.

The join goes down both sides of the index at once. Two nodes differ at least in the bits where
both have a pattern and the patterns differ; where that is beyond the distance, all pairs below are
dropped. Surviving pairs of leaves are compared, once more by nodes of ``SUB`` fingerprints first.

Links are never listed: a leaf gives its own components, and two leaves give a forest between
them. So a ball of many alike fingerprints yields as many rows as it has leaves and components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlake.functions.keys import numbered
from lendlake.llm.components import connected, roots
from lendlake.llm.shared import stored

SEED = 42
HASHES_AT_ONCE = 1 << 16
SUB = 16
PAIRS_AT_ONCE = 1 << 13
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@dataclass(frozen=True)
class Near:
    """``words`` of a shingle, ``bits`` two linked fingerprints may differ in, fingerprints of a
    leaf and children of a node."""

    words: int = 3
    bits: int = 2
    leaf: int = 1024
    fanout: int = 8


def fingerprint(text: str, words: int) -> int:
    """The fingerprint of one text. Words are runs without ASCII white space, lower-cased from A to
    Z only; a text of fewer words than a shingle is one shingle, one without words gives zero."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        begins, ends = begins[:len(found) - words + 1], ends[words - 1:]
    else:
        begins, ends = begins[:1], ends[-1:]
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(begins), HASHES_AT_ONCE):
        some = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(
            begins[some].tolist(), ends[some].tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") \
            .sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(begins), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp of rows (doc_id, text)."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(
                [fingerprint(t.as_py() or "", words) for t in batch.column(1)], type=pa.int64())],
                ["doc_id", "fp"])

    return docs.mapInArrow(made, "doc_id bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """The rank of a 64-bit fingerprint in the Gray code, as a signed number in that order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-1 << 63))


def _blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in nodes of SUB (the last filled up with its last one), and the bits that all
    and that any of a node have."""
    at = np.minimum(np.arange(-len(values) % SUB + len(values)), len(values) - 1)
    blocks = values[at].reshape(-1, SUB)
    return blocks, np.bitwise_and.reduce(blocks, axis=1), np.bitwise_or.reduce(blocks, axis=1)


def near_pairs(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two leaves of fingerprints that differ in at most ``bits`` bits."""
    (a, a_all, a_any), (b, b_all, b_any) = _blocks(left), _blocks(right)
    fixed = (a_all | ~a_any)[:, None] & (b_all | ~b_any)[None, :]
    i, j = np.nonzero(np.bitwise_count((a_all[:, None] ^ b_all[None, :]) & fixed) <= bits)
    out = []
    for at in range(0, len(i), PAIRS_AT_ONCE):
        p, q = i[at:at + PAIRS_AT_ONCE], j[at:at + PAIRS_AT_ONCE]
        k, x, y = np.nonzero(np.bitwise_count(a[p][:, :, None] ^ b[q][:, None, :]) <= bits)
        out.append((np.minimum(p[k] * SUB + x, len(left) - 1), np.minimum(q[k] * SUB + y, len(right) - 1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _leaf_arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(name)
    ends, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[x:y] for x, y in zip(ends, ends[1:])]


def _edges(pairs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate([np.zeros((0, 2), np.uint64), *pairs]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["node", "to"])


def _grouped(leaves: DataFrame, bits: int) -> DataFrame:
    """Leaves with, for each fingerprint, the one that stands for its component in the leaf."""
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _leaf_arrays(batch, "fps")
            tops = [x[roots(len(x), *near_pairs(x, x, bits))] for x in fps]
            values = np.concatenate([np.zeros(0, np.uint64), *tops]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(batch.column("fps").offsets, pa.array(values))],
                ["id", "fps", "tops"])

    return leaves.select("id", "fps").mapInArrow(grouped, "id bigint, fps array<bigint>, tops array<bigint>")


def _between(pairs: DataFrame, bits: int) -> DataFrame:
    """A forest of links between the components of two leaves: node and to."""
    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, a_top, b, b_top in zip(*(_leaf_arrays(batch, x) for x in (
                    "fps", "tops", "other_fps", "other_tops"))):
                i, j = near_pairs(a, b, bits)
                if len(i):
                    ends = np.unique(np.stack([a_top[i], b_top[j]], axis=1), axis=0)
                    names, at = np.unique(ends, return_inverse=True)
                    at = at.reshape(ends.shape)
                    top = roots(len(names), at[:, 0], at[:, 1])
                    moved = top != np.arange(len(names))
                    out.append(np.stack([names[moved], names[top[moved]]], axis=1))
            yield _edges(out)

    return pairs.mapInArrow(between, "node bigint, to bigint")


def _levels(leaves: DataFrame, n: int, fanout: int) -> list[DataFrame]:
    """The upper levels of the index from the lowest to the root: id and its children."""
    nodes, out = leaves.select("id", "all", "any"), []
    while True:
        n = -(-n // fanout)
        up = nodes.groupBy(F.expr(f"id div {fanout}").alias("up")).agg(
            F.collect_list(F.struct("id", "all", "any")).alias("kids"),
            F.bit_and("all").alias("all"), F.bit_or("any").alias("any"))
        up = stored(up.withColumnRenamed("up", "id"), "index-level")
        out.append(up.select("id", "kids"))
        if n <= 1:
            return out
        nodes = up.select("id", "all", "any")


def _met(leaves: DataFrame, n: int, near: Near) -> DataFrame:
    """Pairs of leaves, p <= q, that the patterns of no level keep apart."""
    pairs = None
    for level in reversed(_levels(leaves, n, near.fanout)):
        if pairs is None:  # the root alone
            both = level.select("id", F.col("id").alias("other"), F.col("kids").alias("k"),
                                F.col("kids").alias("m"))
        else:
            both = pairs.join(level.withColumnRenamed("kids", "k"), "id").join(
                level.select(F.col("id").alias("other"), F.col("kids").alias("m")), "other")
        rows = both.select("id", "other", "m", F.explode("k").alias("x")).select(
            F.expr("explode(filter(transform(m, y -> struct(x.id AS id, y.id AS other, bit_count("
                   "(x.all ^ y.all) & (x.all | ~x.any) & (y.all | ~y.any)) AS bits)), "
                   f"z -> z.bits <= {near.bits} AND z.id <= z.other))").alias("z"))
        pairs = stored(rows.select("z.id", "z.other"), "node-pairs")
    return pairs


def links(fps: DataFrame, near: Near = Near()) -> DataFrame:
    """node and to: links between distinct fingerprints (column fp), enough of them to tell which
    are joined by steps of at most ``near.bits`` differing bits."""
    placed = numbered(fps.select("fp", gray_rank(F.col("fp")).alias("rank")), ["rank"], "place")
    leaves = stored(placed.groupBy(F.expr(f"place div {near.leaf}").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("place", "fp"))).alias("fps"),
        F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any"))
        .withColumn("fps", F.col("fps.fp")), "index-leaves")
    n = leaves.count()
    if not n:
        return fps.select(F.col("fp").alias("node"), F.col("fp").alias("to")).limit(0)
    grouped = stored(_grouped(leaves, near.bits), "leaf-components")
    inside = grouped.select(F.explode(F.arrays_zip("fps", "tops")).alias("z")).select(
        F.col("z.fps").alias("node"), F.col("z.tops").alias("to")).where("node <> to")
    pairs = _met(leaves, n, near).where("id < other").join(grouped, "id").join(
        grouped.select(F.col("id").alias("other"), F.col("fps").alias("other_fps"),
                       F.col("tops").alias("other_tops")), "other")
    return inside.unionByName(_between(pairs.select("fps", "tops", "other_fps", "other_tops"), near.bits))


def near_duplicates(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hexadecimal digits) and component_id, the
    least doc_id among the documents that links of fingerprints reach from it, itself included.

    A null or empty text, or one without words, has fingerprint zero and is linked like any other.
    Equal fingerprints are linked. Every row gives one row: rows that repeat an id stay. A null id is
    greater than any other; a component of null ids only has a null component_id. Other columns are
    left out. An empty table gives an empty one.
    """
    rows = stored(fingerprints(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), near.words),
        "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = connected(links(nodes, near)).withColumnRenamed("node", "fp")
    placed = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Both sides come from a shuffle, so a fingerprint of very many documents can be split.
    classes = placed.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
