"""Quality classifier by importance resampling: target against raw hashed n-gram models, Gumbel top-k.

Texts become grams: words, pairs of neighbouring words, ASCII punctuation marks and a mark for a word
that repeats the one before it, hashed into buckets.  The raw model counts the grams of all documents; the target model those of
documents labelled good.  A gram's log ratio is shrunk towards 0 where the target has little to say
(``PRIOR`` pseudo-counts) and grams without clear evidence count as 0.  A first round drops what is far
from the target; the raw model is then counted anew over the rest, so that frequent junk no longer
hides rarer faults.  The score is the sum of log ratios over the square root of the number of grams.

Documents are resampled without replacement in proportion to exp(SHARPNESS * score): Gumbel noise
from a hash of the document is added and the k largest keys stay.  k is the number of documents whose
score is above the cut that separates held-out labelled documents best.

Counts and scores cover all documents; only the target model and the cut use a bounded sample of
labelled rows (``sample``).  Models are dense vectors of fixed size, added up by slices in a stream, so
neither skew nor corpus size changes any task's memory.

Defined results: null and empty texts have score 0; without labelled rows of a kind the cut is below
all scores and everything stays; repeated rows share key and verdict; extra columns survive in
``keep``; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut

from .columns import document_key
from .words import blocks, hash_words, mix64, raw_texts

BITS = 20
BUCKETS = (1 << BITS) + 129
SLICES = 16
PRIOR = 5.0
EVIDENCE = 0.5
FIRST_CUT = -0.2
SHARPNESS = 100.0
SAMPLE = 40_000
MARKS = np.array([33 <= b < 128 and not chr(b).isalnum() for b in range(256)])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram and the text it belongs to."""
    hashes, counts = hash_words(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs = np.flatnonzero(owner[1:] == owner[:-1])
    bigrams = mix64(hashes[pairs] * np.uint64(0xD6E8FEB86659FD93) + hashes[pairs + 1])
    again = pairs[hashes[pairs + 1] == hashes[pairs]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    marks = np.flatnonzero(MARKS[data])
    whose = np.searchsorted(np.cumsum([len(t) for t in texts]), marks, side="right")
    found = np.concatenate(((hashes >> np.uint64(64 - BITS)).astype(np.int64), (bigrams >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(again), BUCKETS - 1),
                            (1 << BITS) + data[marks].astype(np.int64)))
    return found, np.concatenate((owner, owner[pairs], owner[again], whose))


def count_grams(docs: DataFrame, first: Broadcast | None) -> np.ndarray:
    """Gram counts of (text, target) rows: row 0 over all of them, row 1 over targets.

    With a first-round model, texts far from the target are left out of row 0.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts = raw_texts(batch.column(0))
            good = np.array(batch.column(1).to_pylist(), bool)
            for a, b in blocks(texts, 1 << 20):
                found, owner = grams(texts[a:b])
                if first is not None:
                    mean = np.bincount(owner, first.value[found], b - a) / np.maximum(np.bincount(owner, minlength=b - a), 1)
                    total[0] += np.bincount(found[(mean > FIRST_CUT)[owner]], minlength=BUCKETS)
                else:
                    total[0] += np.bincount(found, minlength=BUCKETS)
                    total[1] += np.bincount(found[good[a:b][owner]], minlength=BUCKETS)
        parts = [np.array_split(row, SLICES) for row in total]
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [(s, pack(parts[0][s].tobytes()), pack(parts[1][s].tobytes())) for s in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                         ["slice", "raw", "target"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                vectors = [np.frombuffer(unpack(p), np.int64) for p in packed]
                sums[s] = [x + y for x, y in zip(sums[s], vectors)] if s in sums else vectors
        rows = [(s, v[0].tobytes(), v[1].tobytes()) for s, v in sums.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             ["slice", "raw", "target"])

    kinds = "slice int, raw binary, target binary"
    rows = docs.mapInArrow(count, kinds).repartition(SLICES, "slice").mapInArrow(add, kinds).collect()
    if not rows:
        return np.zeros((2, BUCKETS), np.int64)
    rows.sort(key=lambda r: r["slice"])
    return np.stack([np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in ("raw", "target")])


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Shrunk log ratio of target to raw rates per bucket; 0 without a target."""
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS, np.float32)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def labelled(labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> DataFrame:
    """At most ``sample`` labelled documents (doc_id, good, fit), chosen and halved by a hash of the id."""
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    rows = (labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("doc_id"))
            .agg(F.min(good).alias("good")))
    mixed = F.xxhash64(F.col("doc_id"), F.lit("label"))
    return rows.orderBy(mixed, "doc_id").limit(sample).withColumn("fit", F.pmod(mixed, F.lit(2)) == 0)


def gumbel(key: Column) -> Column:
    """Standard Gumbel noise, a function of the key."""
    u = (F.pmod(F.xxhash64(key, F.lit("gumbel")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """(doc_key, doc_id, n_grams, score) of every row of (doc_id, text), and the cut between good and bad."""
    spark = docs.sparkSession
    chosen = cut(labelled(labels, sample))
    fit = F.broadcast(chosen.filter("fit AND good = 1").select("doc_id", F.lit(True).alias("target")))
    flagged = docs.join(fit, "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    raw, target = count_grams(flagged, None)
    first = log_ratio(target, raw)
    rest, _ = count_grams(flagged, spark.sparkContext.broadcast(first))
    second = log_ratio(target, rest)
    second[np.abs(second) < EVIDENCE] = 0
    models = spark.sparkContext.broadcast((first, second))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = models.value
        for batch in batches:
            texts = raw_texts(batch.column(2))
            counts, scores = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for a, b in blocks(texts, 1 << 20):
                found, owner = grams(texts[a:b])
                n = np.bincount(owner, minlength=b - a)
                mean = np.bincount(owner, one[found], b - a) / np.maximum(n, 1)
                total = np.bincount(owner, two[found], b - a) / np.sqrt(n + 1)
                counts[a:b], scores[a:b] = n, np.where(mean > FIRST_CUT, total, np.minimum(total, 10 * mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts), pa.array(scores)],
                                             ["doc_key", "doc_id", "n_grams", "score"])

    keyed = docs.select(document_key().alias("doc_key"), "doc_id", "text")
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}
    scored = cut(keyed.mapInArrow(score, f"doc_key {kinds['doc_key']}, doc_id {kinds['doc_id']}, n_grams long, score double"))
    held = scored.join(F.broadcast(chosen.filter("NOT fit")), "doc_id").select("score", "good").toPandas()
    return scored, best_cut(held["score"].to_numpy(), held["good"].to_numpy() == 1)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the least sum of error rates: bad documents at or above it, good ones below."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    lost = np.cumsum(good[order]) / good.sum()
    caught = np.cumsum(~good[order]) / (~good).sum()
    edge = np.append(np.diff(scores[order]) > 0, True)
    at = int(np.argmax(np.where(edge, caught - lost, -1)))
    if caught[at] <= lost[at]:
        return -np.inf
    upper = scores[order][at + 1] if at + 1 < len(order) else np.inf
    return float((scores[order][at] + min(upper, scores[order][at] + 1)) / 2)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value, by histograms that narrow down to the bin that holds it."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return float("inf")
    if k >= n:
        return low
    while high > low and high - low > 1e-12 * max(1.0, abs(high)):
        width = (high - low) / bins
        inside = df.filter(F.col(column).between(low, high))
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width))
        rows = sorted(inside.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"),
                                                          F.max(column).alias("hi")).collect(), reverse=True)
        above = df.filter(F.col(column) > high).count()
        for r in rows:
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
        if above + 1 == k:
            return high
    return low


def resample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_key, doc_id, n_grams, score, key, kept): the k documents that Gumbel top-k keeps are marked."""
    scored, edge = score_documents(docs.select("doc_id", "text"), labels, sample)
    keyed = cut(scored.withColumn("key", SHARPNESS * F.col("score") + gumbel(F.col("doc_key"))))
    k = keyed.filter(F.col("score") >= edge).count()
    return keyed.withColumn("kept", F.col("key") >= kth_largest(keyed, "key", k))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The resampled documents, in the input's columns."""
    marks = resample(docs, labels, sample).filter("kept").select("doc_key").distinct()
    place = "_doc_key"
    return docs.withColumn(place, document_key()).join(marks, F.col(place) == marks["doc_key"], "left_semi").drop(place)
