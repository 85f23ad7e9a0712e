"""Near copies by SimHash, with fingerprints compared as vertical bit planes.

A fingerprint has a bit set where over half of a text's word shingles have it in their XXH64.  Two
fingerprints within ``radius`` bits agree in one of ``radius + 1`` bands, so each one is listed once per
band and compared with those that share the band's bits.  Bit p of 64 neighbouring fingerprints is one
machine word: a plane word is met by a fingerprint with one exclusive or, and the 64 distances grow in
carry-save counters, which start so high that a carry out of the last counter means "beyond the radius".
Blocks whose 64 lanes are all beyond it are abandoned every few planes.  A task hands on no pairs but at
most one link per fingerprint and bucket, to a member of its group.

Buckets above ``limit`` fingerprints are found by a count beforehand and split anew by bands of the bits
in which they do not agree yet, until none is larger: exact at any size, and no task holds a larger one.

Nulls: a null text is an empty one; empty texts have fingerprint zero and form one group; null ids stay and
are never the id of a group that has another.  Repeated rows are returned as often as they come.  Very long
texts are hashed in blocks.  Ties do not arise: a group's id is its least document id.  An empty table gives
an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut, small_side

from .columns import hot_join
from .components import components
from .words import LOWER, raw_texts

RADIUS = 3
SHINGLE = 3
SEED = 42
LIMIT = 16_384
"""Fingerprints that one bucket may hold before it is split further."""
BATCH = 1 << 16
BLOCKS = 1 << 15
"""Pairs of a fingerprint and a block of 64 that are compared at once."""
STEP = 8
"""Planes between two looks for abandoned blocks."""
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The majority of the shingles' hashes, bit by bit; zero without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate(([0], stops[:-1] + 1))[:len(words) - size + 1].tolist()
    ends = stops[size - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 8192):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + 8192], ends[at:at + 8192])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print) of every row; the fingerprint's 64 bits as a long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in raw_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "print"])

    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, print long")


def bands(mask: int, n: int) -> list[int]:
    """The bits outside a mask in n runs, each joined with the mask."""
    free = [p for p in range(64) if not mask >> p & 1]
    runs = [free[len(free) * i // n:len(free) * (i + 1) // n] for i in range(n)]
    return [mask | sum(1 << p for p in run) for run in runs]


def split(rows: DataFrame, masks: list[int], n: int) -> DataFrame:
    """(mask, value, print): each fingerprint once per band of its present mask."""
    long = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    literal = F.create_map(*[x for m in masks for x in (long(m), F.array(*[long(b) for b in bands(m, n)]))])
    listed = rows.select("print", F.explode(literal[F.col("mask")]).alias("mask"))
    return listed.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")


def bucketed(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """All fingerprints in buckets of at most ``limit``; every pair within the radius meets in one of them."""
    masks, done = [0], None
    rows = split(prints.select("print", F.lit(0).cast("long").alias("mask")), masks, radius + 1)
    while True:
        large = cut(rows.groupBy("mask", "value").count().filter(F.col("count") > limit))
        if large.isEmpty():
            return done.union(rows) if done else rows
        told = rows.join(small_side(large), ["mask", "value"], "left")
        small = told.filter("count IS NULL").drop("count")
        done = done.union(small) if done else small
        masks = [r["mask"] & (1 << 64) - 1 for r in large.select("mask").distinct().collect()]
        rows = cut(split(told.filter("count IS NOT NULL"), masks, radius + 1))


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit p of fingerprints 64 w to 64 w + 63 as word w of row p."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[:len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def near(prints: np.ndarray, stops: np.ndarray, mask: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j < stops[i], of fingerprints within the radius; all agree on the mask's bits."""
    vertical = planes(prints)
    order = [p for p in range(64) if not mask >> p & 1]
    counters = max(1, radius.bit_length())
    head = (1 << counters) - 1 - radius
    at = np.arange(len(prints))
    first, last = (at + 1) >> 6, (stops - 1) >> 6
    each = np.where(stops > at + 1, last - first + 1, 0)
    ends = np.cumsum(each)
    start = 0
    while start < len(prints):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BLOCKS, "right")))
        n = each[start:stop]
        query = np.repeat(at[start:stop], n)
        block = first[query] + np.arange(len(query)) - np.repeat(np.cumsum(n) - n, n)
        start = stop
        if not len(query):
            continue
        low = np.maximum(query + 1 - 64 * block, 0).astype(np.uint64)
        high = (64 - np.minimum(stops[query] - 64 * block, 64)).astype(np.uint64)
        beyond = ~((ALL << low) & (ALL >> high))
        count = [np.full(len(query), ALL if head >> c & 1 else 0, np.uint64) for c in range(counters)]
        wanted = prints[query]
        for k, p in enumerate(order):
            carry = vertical[p][block] ^ (np.uint64(0) - (wanted >> np.uint64(p) & np.uint64(1)))
            for plane in count:
                over = plane & carry
                plane ^= carry
                carry = over
            beyond |= carry
            if k % STEP == STEP - 1:
                alive = beyond != ALL
                if not alive.all():
                    query, block, wanted, beyond = query[alive], block[alive], wanted[alive], beyond[alive]
                    count = [plane[alive] for plane in count]
                    if not len(query):
                        break
        if len(query):
            row, lane = np.nonzero(np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[row], 64 * block[row] + lane


def join_groups(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all positions that links connect their least label, in place."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def compared(masks: np.ndarray, values: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the groups within each bucket: a fingerprint and the first one of its group."""
    if not len(prints):
        return prints, prints
    new = np.concatenate(([True], (masks[1:] != masks[:-1]) | (values[1:] != values[:-1])))
    edges = np.append(np.flatnonzero(new), len(prints))
    stops = np.repeat(edges[1:], np.diff(edges))
    label = np.arange(len(prints))
    turns = np.append(np.flatnonzero(np.concatenate(([True], masks[1:] != masks[:-1]))), len(prints)).tolist()
    for a, b in zip(turns, turns[1:]):
        for i, j in near(prints[a:b], stops[a:b] - a, int(masks[a]), radius):
            join_groups(label, i + a, j + a)
    tied = np.flatnonzero(label != np.arange(len(prints)))
    return prints[label[tied]], prints[tied]


def links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """(a, b): links between distinct fingerprints whose components are those of all links within the radius."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64)] * 3

        def found(whole: int) -> pa.RecordBatch:
            tied = compared(*[x[:whole] for x in held], radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in tied], ["a", "b"])

        for batch in batches:
            held = [np.concatenate((x, np.asarray(c).view(np.uint64))) for x, c in zip(held, batch.columns)]
            if len(held[0]) >= BATCH:
                earlier = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                whole = int(earlier[-1]) + 1 if len(earlier) else 0
                yield found(whole)
                held = [x[whole:] for x in held]
        yield found(len(held[0]))

    placed = bucketed(prints, radius, limit).repartition("mask", "value").sortWithinPartitions("mask", "value")
    return placed.mapInArrow(run, "a long, b long")


def report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS,
           shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the component's least id over chains of links."""
    marked = cut(fingerprints(docs, id_column, text_column, shingle))
    prints = cut(marked.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links(prints, radius, limit)).withColumnRenamed("node", "print")
    known = cut(prints.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    groups = cut(known.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(hot_join(known.select("print", "root"), groups, "root").select("print", "component_id"))
    return hot_join(marked, named, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
