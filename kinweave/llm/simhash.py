"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint of 64 bits becomes a point of a lattice: the number of set bits in each four-bit segment.  The
Manhattan distance of two points is a lower bound of the fingerprints' Hamming distance, so fingerprints that differ
in two bits or fewer have points at most two apart, and two such points have a lattice point within one step of both.
The grid range join is an equality join on these: every fingerprint is put into the cell of its own point and those
one step away, and cells with a single fingerprint are dropped.

What met in a cell is verified exactly, also by equality: of two fingerprints that differ in at most two bits, one
bit of each at most can be flipped to make them equal, and the cell of what they become is one that both are in.  So
a fingerprint offers, for each cell it shares, what it becomes there by one flipped bit (or none), and all that offer
the same (65 fingerprints at most, each within two bits of the others) are linked to the smallest of them.  Every pair
within the distance is in one component so, no link is longer than two bits, and no cell, however full, is expanded
into pairs.

Defined results: null and empty texts (and those without a word) have fingerprint zero and link like any other;
texts with fewer than three words are one shingle; a null doc_id takes part and is never the smallest unless
alone; repeated rows share a fingerprint, and of a component one row stays, whatever its doc_id; other columns are
ignored by `dedup` and kept by `drop_near_copies`; very long texts are hashed whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import bounded, components, discard, join_skewed, located, materialize, small_batches
from kinweave.llm.hashing import words_in, xxh64

#: Bits of a segment; its count takes as many bits of the packed point.
SEGMENT = 4
PAIRS, NIBBLES = 0x5555555555555555, 0x3333333333333333
#: Texts of so many bytes are hashed at a time.
CHUNK_BYTES = 2_000_000


def fingerprint_texts(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """SimHash of each text; the whole batch is hashed in chunks of bounded size."""
    out = np.zeros(len(texts), np.uint64)
    part: list[bytes] = []
    where: list[int] = []
    size = 0

    def flush() -> None:
        if not part:
            return
        buf, start, end, counts = words_in(part)
        first = np.cumsum(counts) - counts
        n = np.maximum(counts - shingle + 1, 1)
        begin = np.cumsum(n) - n
        at = np.arange(n.sum()) - np.repeat(begin - first, n)
        last = np.minimum(at + shingle - 1, np.repeat(first + counts - 1, n))
        total = np.empty((len(part), 64), np.int64)
        h = xxh64(buf, start[at], end[last] - start[at])
        # Whole documents at a time, so that the unpacked bits stay small.
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(begin + n, begin[lo] + 200_000, "right")))
            a, b = begin[lo], begin[hi - 1] + n[hi - 1]
            if hi == lo + 1:
                total[lo] = sum(np.unpackbits(h[i : min(b, i + 200_000)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(a, b, 200_000))
            else:
                bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                total[lo:hi] = np.add.reduceat(bits, begin[lo:hi] - a, axis=0, dtype=np.int32)
            lo = hi
        out[where] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        part.clear()
        where.clear()

    for i, t in enumerate(texts):
        words = t.lower().split() if t else None
        if words:
            part.append(b" ".join(words))
            where.append(i)
            size += len(part[-1])
            if size > CHUNK_BYTES:
                flush()
                size = 0
    flush()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        fp = np.concatenate([np.zeros(0, np.uint64), *(fingerprint_texts(texts.slice(i, 512).to_pylist()) for i in range(0, len(texts), 512))])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), b.column(2)], names=["doc_id", "fp", "locator"])


def fingerprints(docs: DataFrame, place: Column | None = None) -> DataFrame:
    """doc_id, the 64-bit fingerprint as a signed long, and `place` as `locator`."""
    small_batches(docs.sparkSession)
    where = F.lit("") if place is None else place
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where.alias("locator")).mapInArrow(_fingerprints, "doc_id bigint, fp bigint, locator string")


def embed(fp: Column) -> Column:
    """The 16 segment counts, four bits each."""
    # Sums of neighbouring bits without addition, whose carry would reach the sign.
    a, b = fp.bitwiseAND(F.lit(PAIRS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(PAIRS))
    two = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))
    return two.bitwiseAND(F.lit(NIBBLES)) + F.shiftrightunsigned(two, 2).bitwiseAND(F.lit(NIBBLES))


def _cells(pc: Column) -> Column:
    """The point and the lattice points one step away."""
    steps = []
    for s in range(0, 64, SEGMENT):
        count = F.shiftrightunsigned(pc, s).bitwiseAND(F.lit(15))
        steps += [F.when(count < SEGMENT, pc + F.lit(1 << s)), F.when(count > 0, pc - F.lit(1 << s))]
    return F.filter(F.array(pc, *steps), lambda c: c.isNotNull())


def _offers(fp: Column, pc: Column, cell: Column) -> Column:
    """What the fingerprint becomes in the cell by one flipped bit; in its own cell, itself."""
    step = F.abs(cell - pc)
    bits = [F.shiftleft(step, j) for j in range(SEGMENT)]
    flips = [F.when((fp.bitwiseAND(b) == 0) == (cell > pc), fp.bitwiseXOR(b)) for b in bits]
    return F.when(cell == pc, F.array(fp)).otherwise(F.filter(F.array(*flips), lambda x: x.isNotNull()))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of column `fp`, two bits long at most, that keep every component."""
    points = materialize(fps.select("fp", embed(F.col("fp")).alias("pc")).select("fp", "pc", F.explode(_cells(F.col("pc"))).alias("cell")), "cells")
    shared = points.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    offers = materialize(points.join(shared, "cell").select("fp", F.explode(_offers(F.col("fp"), F.col("pc"), F.col("cell"))).alias("offer")), "offers")
    discard(points)
    best = offers.groupBy("offer").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("offer", "v")
    edges = materialize(offers.join(best, "offer").where("fp <> v").select(F.col("fp").alias("u"), "v").distinct(), "links")
    discard(offers)
    return edges


def grouped(rows: DataFrame) -> DataFrame:
    """fp, n, first: for each distinct fingerprint its number of rows and the first row of its component.

    `first` is a struct with doc_id and locator, the smallest by doc_id (null last), then locator.
    """
    own = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id_order"), "locator", "doc_id")
    fps = materialize(rows.groupBy("fp").agg(F.min(own).alias("own"), F.count("*").alias("n")), "fps")
    linked = components(links(fps))
    root = fps.join(linked, fps["fp"] == linked["node"], "left").select("fp", "n", "own", F.coalesce("root", "fp").alias("root"))
    first = root.groupBy("root").agg(F.min("own").alias("first"))
    return root.join(first, "root").select("fp", "n", "first")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp, component_id (smallest doc_id reachable over links of two bits)."""
    rows = materialize(fingerprints(docs), "fp")
    return join_skewed(rows, materialize(grouped(rows), "groups"), "fp", "n").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, the one with the smallest doc_id."""
    docs, place = located(docs)
    rows = materialize(fingerprints(docs, place), "fp")
    judged = join_skewed(rows, materialize(grouped(rows), "groups"), "fp", "n", limit=100_000)
    gone = bounded(materialize(judged.where("locator <> first.locator").select(F.col("locator").alias("__locator")), "near"))
    return docs.join(gone, place == gone["__locator"], "left_anti")
