"""N-gram Jaccard join by chosen paths: split sets on sampled shared tokens, compare small buckets.

A document is the set of its word shingles.  In each run a set goes to the bucket of one sampled token
(the least of its shingles under a random order, so two sets meet with probability equal to their
similarity).  Buckets of at most ``limit`` sets are compared pair by pair; larger ones are split again
by the next sampled token, up to ``depth`` times.  Runs repeat until a pair at the threshold is found
with probability ``recall`` at two splits; sets whose buckets are larger after these get the further runs
that ``depth`` splits take.  What no split makes small are crowds, sets that agree nearly everywhere.
Crowds with common members are one, and all pairs of a crowd are compared exactly: its sets are dealt out
to blocks of about ``block``, each pair of blocks is one matrix product of sets by tokens, and a task
holds two blocks.  Such a pair of blocks gives each set's number of links and a tree of links, so the links
of a crowd are counted, all of them, but never listed.  All other candidates are checked exactly, by the
Jaccard similarity of their whole shingle sets.

Equal word sequences are one class from the start: copies share a row from then on.  Buckets are
counted before rows are gathered, so no task ever holds more than ``limit`` sets of one bucket.

Defined results: texts without words match only equal texts; null is empty; repeated rows (same id and
text) get equal rows; an empty table stays empty; extra columns survive in ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut

from .columns import document_key
from .components import components
from .words import ALNUM, blocks, hash_words, raw_texts, shingles

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
DEPTH = 5
LIMIT = 64
MARGIN = 0.22
BLOCK = 256
TOKENS_AT_A_TIME = 8192


def runs_for(threshold: float, recall: float, splits: int = 2) -> int:
    """Runs after which a pair at the threshold has met in a bucket of so many splits with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** splits))


def signatures(docs: DataFrame, tokens: int, k: int = SHINGLE) -> DataFrame:
    """(doc_key, doc_id, class, coords) of rows (doc_key, doc_id, text).

    ``class`` identifies the word sequence; ``coords`` are the sampled tokens of the shingle set, null
    without words.
    """
    seeds = np.random.default_rng(5).integers(1, 1 << 63, tokens, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(2))
            digests, coords = [], []
            for a, b in blocks(texts, 1 << 20):
                hashes, counts = hash_words(texts[a:b])
                found, sizes = shingles(hashes, counts, k)
                digests += [xxhash.xxh3_128_digest(b" ".join(t.translate(ALNUM).split()) if n else b"\0" + t)
                            for t, n in zip(texts[a:b], sizes)]
                rows = np.flatnonzero(sizes)
                least = np.zeros((b - a, tokens), np.int32)
                if len(rows):
                    starts = (np.cumsum(sizes) - sizes)[rows]
                    for j, seed in enumerate(seeds):
                        least[rows, j] = (np.minimum.reduceat(found * seed, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                coords += [least[i] if n else None for i, n in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()),
                                              pa.array(coords, pa.list_(pa.int32()))], ["doc_key", "doc_id", "class", "coords"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, f"doc_key {kinds['doc_key']}, doc_id {kinds['doc_id']}, class binary, coords array<int>")


def bucketed(rows: DataFrame) -> DataFrame:
    """Rows (class, run, path) of buckets with company, with the bucket's size n."""
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return cut(rows.join(counts, "path"))


def compared(small: DataFrame, coords: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of small buckets whose sampled tokens agree often enough to be candidates.

    ``coords`` are (class, coords, crowd); pairs of one crowd are left out, as all of them are compared there.
    """
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0).to_pylist():
                members.sort(key=lambda m: m["class"])
                matrix = np.array([m["coords"] for m in members], np.int32)
                for i in range(len(members) - 1):
                    for j in np.flatnonzero((matrix[i + 1:] == matrix[i]).mean(axis=1) >= least) + i + 1:
                        if members[i]["crowd"] is None or members[i]["crowd"] != members[j]["crowd"]:
                            left.append(members[i]["class"])
                            right.append(members[j]["class"])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    gathered = small.join(coords, "class").groupBy("path").agg(F.collect_list(F.struct("class", "coords", "crowd")).alias("members"))
    return gathered.select("members").mapInArrow(pairs, "a binary, b binary")


def candidates(classes: DataFrame, threshold: float, recall: float, depth: int = DEPTH,
               limit: int = LIMIT) -> tuple[DataFrame, DataFrame | None]:
    """Distinct candidate pairs (a, b), a < b, of classes (class, coords), and (node, root) of the crowds, whose
    pairs are left out of the candidates; none if no bucket is large after all splits."""
    runs, least = runs_for(threshold, recall), max(0.0, threshold - MARGIN)
    sampled = classes.select("class", F.slice("coords", 1, runs * depth).alias("coords"))
    small, crowds, start, taking = [], classes.limit(0).select("class", F.lit(0).cast("long").alias("path")), 0, classes
    for splits in sorted({min(2, depth), depth}):
        # Sets whose buckets are too large after two splits get the runs that all splits take.
        stop, deep = runs_for(threshold, recall, splits), None
        token = F.get("coords", F.col("run") * depth)
        rows = bucketed(taking.select("class", "coords", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("run"))
                        .select("class", "run", F.xxhash64("run", token).alias("path")))
        for level in range(1, depth + 1):
            small.append(rows.filter(F.col("n") <= limit).select("class", "path"))
            large = rows.filter(F.col("n") > limit).drop("n")
            if level == splits:
                deep = large.select("class").distinct()
            if large.isEmpty():
                break
            if level == depth:
                crowds = crowds.union(large.select("class", "path"))
            else:
                token = F.get("coords", F.col("run") * depth + level)
                rows = bucketed(large.join(classes, "class").select("class", "run", F.xxhash64("path", token).alias("path")))
        start = stop
        if splits == depth or deep is None:
            break
        taking = cut(taking.join(deep, "class", "left_semi"))
        if taking.isEmpty():
            break
    crowd = None if crowds.isEmpty() else crowded(crowds)
    known = F.lit(None).cast("binary") if crowd is None else F.col("crowd")
    if crowd is not None:
        sampled = sampled.join(crowd.select(F.col("node").alias("class"), F.col("root").alias("crowd")), "class", "left")
    sampled = sampled.select("class", "coords", known.alias("crowd"))
    return cut(compared(reduce(DataFrame.union, small), sampled, least).distinct()), crowd


def crowded(crowds: DataFrame) -> DataFrame:
    """(node, root): the crowd of each class; buckets (class, path) with common members are one crowd."""
    least = crowds.groupBy("path").agg(F.min("class").alias("b"))
    return components(crowds.join(least, "path").filter(F.col("class") != F.col("b")).select(F.col("class").alias("a"), "b").distinct())


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of all sets on the left with all on the right."""
    tokens, found = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    places = np.split(found, [len(rows[0])])
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(tokens), TOKENS_AT_A_TIME):
        parts = []
        for side, row, place in zip((left, right), rows, places):
            inside = (place >= start) & (place < start + TOKENS_AT_A_TIME)
            part = np.zeros((len(side), min(TOKENS_AT_A_TIME, len(tokens) - start)), np.float32)
            part[row[inside], place[inside] - start] = 1
            parts.append(part)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


def tree_of(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that connect what the matrix of links connects, at most one less than there are sets."""
    edges, rows, columns = [], set(range(linked.shape[0])), np.ones(linked.shape[1], bool)
    while rows:
        stack = [rows.pop()]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i] & columns):
                columns[j] = False
                edges.append((i, int(j)))
                for other in np.flatnonzero(linked[:, j]):
                    if int(other) in rows:
                        rows.remove(int(other))
                        edges.append((int(other), int(j)))
                        stack.append(int(other))
    return edges


def linked_blocks(crowd: DataFrame, tokens: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, n): of all pairs of a crowd (node, root), ``n`` links more of class ``a``, or a link of the trees (n null)."""
    sizes = crowd.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    dealt = (crowd.join(sizes, "root").withColumn("parts", F.ceil(F.col("n") / block))
             .withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))))
    blocks = dealt.join(tokens, dealt["node"] == tokens["class"]).select("root", "part", "parts", "class", "tokens")
    met = (blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
           .select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "class", "tokens"))
    pairs = (met.groupBy("root", "lo", "hi")
             .agg(*[F.collect_list(F.when(F.col("part") == F.col(side), F.struct("class", "tokens"))).alias(side + "_sets")
                    for side in ("lo", "hi")]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                lo, hi, left, right = (c[i].as_py() for c in batch.columns)
                right = left if lo == hi else right
                names = [[m["class"] for m in side] for side in (left, right)]
                sets = [[unpacked(m["tokens"]) for m in side] for side in (left, right)]
                if not sets[0] or not sets[1]:
                    continue
                sizes = [np.array([len(x) for x in side]) for side in sets]
                both = shared_tokens(*sets)
                linked = both / np.maximum(sizes[0][:, None] + sizes[1] - both, 1) >= threshold - 1e-9
                if lo == hi:
                    np.fill_diagonal(linked, False)
                counts = [linked.sum(axis=1), linked.sum(axis=0)][:1 + (lo != hi)]
                a, n = [], []
                for side, count in zip(names, counts):
                    some = np.flatnonzero(count)
                    a += [side[k] for k in some]
                    n += count[some].tolist()
                b = [None] * len(a)
                for x, y in tree_of(linked):
                    a.append(names[0][x])
                    b.append(names[1][y])
                    n.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return cut(pairs.select("lo", "hi", "lo_sets", "hi_sets").mapInArrow(compare, "a binary, b binary, n long"))


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()


def packed(tokens: np.ndarray) -> bytes:
    """The distinct tokens of a set, 40 bits each: enough to tell those of two texts apart."""
    return np.unique(tokens & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def token_sets(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(class, tokens) of (class, text)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, texts = [], raw_texts(batch.column(1))
            for a, b in blocks(texts, 1 << 20):
                found, sizes = shingles(*hash_words(texts[a:b]), k)
                made += [packed(part) for part in np.split(found, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["class", "tokens"])

    return texts.mapInArrow(sets, "class binary, tokens binary")


def verified(pairs: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets (class, tokens) are similar enough, with their similarity."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (c.to_pylist() for c in batch.columns)
            kept = []
            for i, (x, y) in enumerate(zip(left, right)):
                x, y = unpacked(x), unpacked(y)
                if min(len(x), len(y)) >= (threshold - 1e-9) * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    similarity = both / max(len(x) + len(y) - both, 1)
                    if similarity >= threshold - 1e-9:
                        kept.append((a[i], b[i], similarity))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*kept) if kept else ([], [], []), (pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "similarity"])

    both = (pairs.join(tokens.withColumnsRenamed({"class": "a", "tokens": "left"}), "a")
            .join(tokens.withColumnsRenamed({"class": "b", "tokens": "right"}), "b"))
    return cut(both.select("a", "b", "left", "right").mapInArrow(check, "a binary, b binary, similarity double"))


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, k: int = SHINGLE,
         depth: int = DEPTH, limit: int = LIMIT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents with their class and group, and the number of links of each class that has one.

    Returns (doc_key, doc_id, class, root, first, copies) per row of docs(doc_id, text): ``root`` names
    the group of linked classes and ``first`` is its least document key; and (class, n_links).
    """
    keyed = docs.select(document_key().alias("doc_key"), "doc_id", "text")
    signed = cut(signatures(keyed, runs_for(threshold, recall, max(2, depth)) * depth, k))
    classes = cut(signed.groupBy("class").agg(F.min("doc_key").alias("first"), F.count(F.lit(1)).alias("copies"),
                                              F.first("coords").alias("coords")))
    coords = classes.filter("coords IS NOT NULL").select("class", "coords")
    pairs, crowd = candidates(coords, threshold, recall, depth, limit)
    met = ends_of(pairs) if crowd is None else ends_of(pairs).union(crowd.select("node")).distinct()
    first = classes.join(met, "class").select("class", F.col("first").alias("doc_key"))
    texts = keyed.join(first, "doc_key").dropDuplicates(["class"]).select("class", "text")
    tokens = cut(token_sets(texts, k))
    links = verified(pairs, tokens, threshold).select("a", "b")
    counts = links.select(F.col("a").alias("class"), F.lit(1).alias("n")).union(links.select("b", F.lit(1)))
    if crowd is not None:
        inside = linked_blocks(crowd, tokens, threshold, block)
        links = links.union(inside.filter("n IS NULL").select("a", "b"))
        counts = counts.union(inside.filter("n IS NOT NULL").select("a", "n"))
    roots = components(links)
    grouped = classes.join(roots, classes["class"] == roots["node"], "left").withColumn("root", F.coalesce("root", "class"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    named = cut(grouped.join(least, "root").select("class", "root", F.col("least").alias("first"), "copies"))
    return signed.drop("coords").join(named, "class"), counts.groupBy("class").agg(F.sum("n").alias("n_links"))


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the group's first doc_id), copies of its text and links to different texts."""
    members, degree = join(docs, **options)
    return (members.join(degree, "class", "left")
            .select("doc_id", F.col("first.id").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The first document of each group, in the input's columns; of repeated rows one stays."""
    members, _ = join(docs.select("doc_id", "text"), **options)
    firsts = members.select("first").distinct()
    keyed = docs.withColumn("_doc_key", document_key())
    return keyed.join(firsts, keyed["_doc_key"] == firsts["first"], "left_semi").dropDuplicates(["_doc_key"]).drop("_doc_key")
