"""Language-model scoring with an Elias-Fano n-gram trie (two levels: words and their successors).

Level one holds the hashes of all training words in order, so a word's id is its place, and pointers:
running token counts, whose differences are exact word counts.  Level two holds all training bigrams
in order of (context, successor), pointers to the first successor of every context, and a quantised
probability for each bigram.  All three are Elias-Fano sequences.  A bigram is found by searching the
successor relative to its context's place in the order.

The model is absolute discounting, interpolated down to the uniform distribution:
p(w|v) = max(c(vw) - D, 0) / c(v) + D n(v) / c(v) p(w), and p(w) likewise over N tokens with one unknown
word.  c and n are exact (from pointers); the discounted bigram part is the quantised one.

Levels are cut into shards that are built in parallel: words by hash range, bigrams by ranges of equal
token mass, so a very frequent context is spread over as many shards as it needs.  Tasks send sorted,
compressed blocks of counted keys, never single rows.  Shards are files in the shared folder, written
under another name and renamed, and memory-mapped by the scoring tasks, which read the pages they need.

Defined results: a null or empty text is its end token alone; repeated rows count and score each;
without training rows every text scores 0; extra columns are dropped.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import checkpoint_dir

from .elias_fano import EliasFano
from .words import LOWER, blocks, hash_words, raw_texts

END = np.uint64(0x9D3F2C81A7B5E643)
DISCOUNT = 0.75
STEPS = 4096
"""Steps of a quantised log10 probability per unit."""
HELD = 2_000_000
ROWS = "shard int, keys binary, counts binary"


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end for each text) and the number of tokens of each text."""
    words, counts = hash_words([t.translate(LOWER) for t in texts], None)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    joined, weights = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(joined, kind="stable")
    joined = joined[order]
    starts = np.flatnonzero(np.concatenate(([True], joined[1:] != joined[:-1]))) if len(joined) else np.empty(0, int)
    return joined[starts], np.add.reduceat(weights[order], starts) if len(starts) else weights[:0]


def counted_blocks(found: Iterator[tuple[np.ndarray, np.ndarray]], shard_of) -> Iterator[pa.RecordBatch]:
    """Blocks of summed keys by shard; at most about ``HELD`` keys are held back."""
    keys, counts, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        k, c = summed(keys, counts)
        shards = shard_of(k)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(k)]))
        pack = zstandard.ZstdCompressor(level=1).compress
        rows = [(int(shards[a]), pack_sorted(k[a:b]), pack(c[a:b].astype(np.int64).tobytes())) for a, b in zip(starts[:-1], starts[1:]) if b > a]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()))],
                                         ["shard", "keys", "counts"])

    for k, c in found:
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > HELD:
            k, c = summed(keys, counts)
            keys, counts, held = [k], [c], len(k)
            if held > HELD // 2:
                yield from flush()
                keys, counts, held = [], [], 0
    if held:
        yield from flush()


def save(path: str, arrays: dict[str, np.ndarray], facts: dict) -> None:
    """All arrays of a shard in one file: a length, a header, then the arrays at 64-byte steps."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (at, len(a), a.dtype.str)
        at += -(-a.nbytes // 64) * 64
    header = json.dumps({"arrays": places, "facts": facts}).encode()
    start = -(-(8 + len(header)) // 64) * 64
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(header).to_bytes(8, "little") + header)
        for name, a in arrays.items():
            f.seek(start + places[name][0])
            f.write(a.tobytes())
        f.truncate(start + at)
    os.replace(part, path)


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """The memory-mapped arrays of a shard, and its facts."""
    with open(path, "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(size))
    start = -(-(8 + size) // 64) * 64
    data = np.memmap(path, np.uint8, "r")
    found = {}
    for name, (at, n, kind) in header["arrays"].items():
        found[name] = data[start + at:start + at + n * np.dtype(kind).itemsize].view(kind)
    return found, header["facts"]


def coded(prefix: str, e: EliasFano) -> tuple[dict[str, np.ndarray], dict]:
    return {f"{prefix}_{k}": v for k, v in e.arrays().items()}, {f"{prefix}_n": e.n, f"{prefix}_low": e.low}


def decoded(prefix: str, arrays: dict[str, np.ndarray], facts: dict) -> EliasFano:
    return EliasFano(facts[f"{prefix}_n"], facts[f"{prefix}_low"], *(arrays[f"{prefix}_{k}"] for k in ("lows", "bits", "ones")))


class Trie:
    """A view of the model's files; shards are mapped when first used."""

    def __init__(self, folder: str, facts: dict) -> None:
        self.folder, self.facts = folder, facts
        self.shards, self.bits = facts["shards"], facts["shards"].bit_length() - 1
        self.opened: dict[tuple[str, int], tuple] = {}

    def words(self, shard: int) -> tuple[EliasFano, EliasFano]:
        if ("words", shard) not in self.opened:
            arrays, facts = load(f"{self.folder}/words-{shard}")
            self.opened["words", shard] = decoded("hash", arrays, facts), decoded("tokens", arrays, facts)
        return self.opened["words", shard]

    def pairs(self, shard: int) -> tuple | None:
        if ("pairs", shard) not in self.opened:
            path = f"{self.folder}/pairs-{shard}"
            if not os.path.exists(path):
                self.opened["pairs", shard] = None
            else:
                arrays, facts = load(path)
                self.opened["pairs", shard] = (decoded("next", arrays, facts), decoded("start", arrays, facts), arrays["codes"],
                                               facts["first_key"], facts["first_context"])
        return self.opened["pairs", shard]

    def by_shard(self, shards: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Runs of equal shards in an ascending array."""
        edges = np.concatenate(([0], np.flatnonzero(np.diff(shards)) + 1, [len(shards)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b > a:
                yield int(shards[a]), slice(a, b)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, count, tokens before the word) of ascending distinct hashes."""
        ids, counts, before = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        shards = word_shard(hashes, self.bits)
        for s, part in self.by_shard(shards):
            if not self.facts["words"][s]:
                continue
            coded_hashes, tokens = self.words(s)
            wanted = hashes[part] - (np.uint64(s) << np.uint64(64 - self.bits) if self.bits else np.uint64(0))
            place = coded_hashes.successor(wanted)
            known = place < coded_hashes.n
            known[known] = coded_hashes.access(place[known]) == wanted[known]
            at = place[known]
            low = tokens.access(at).astype(np.int64)
            rows = np.arange(part.start, part.stop)[known]
            ids[rows] = at + self.facts["first_id"][s]
            counts[rows] = tokens.access(at + 1).astype(np.int64) - low
            before[rows] = low + self.facts["first_token"][s]
        return ids, counts, before

    def pair_shard(self, before: np.ndarray, counts: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Shard of (context, successor): equal shares of the token mass, a context's share by successor id."""
        mass = before + counts * (successor / max(self.facts["v"], 1))
        total = self.facts["n"] + self.facts["texts"]
        return np.minimum((mass * (self.shards / max(total, 1))).astype(np.int64), self.shards - 1)


def word_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def merged(rows: DataFrame, shards: int, write) -> list:
    """Sum the blocks of each shard in one task and write the shard; the facts of all shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, counts = -1, [], []
        unpack = zstandard.ZstdDecompressor().decompress

        def done() -> pa.RecordBatch:
            facts = write(held, *summed(keys, counts))
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([json.dumps(facts)], pa.string())], ["shard", "facts"])

        for batch in batches:
            for shard, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                if shard != held:
                    if keys:
                        yield done()
                    held, keys, counts = shard, [], []
                keys.append(unpack_sorted(k))
                counts.append(np.frombuffer(unpack(c), np.int64))
                if sum(map(len, keys)) > 2 * HELD:
                    k, c = summed(keys, counts)
                    keys, counts = [k], [c]
        if keys:
            yield done()

    dealt = rows.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, facts string").collect()


def local_folder(spark, folder: str | None) -> str:
    """A folder that driver and executors share and can map files from."""
    place = urlparse(folder or checkpoint_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"{place.geturl()} cannot be memory-mapped; name a folder that all machines mount")
    return f"{place.path}/trie-{uuid.uuid4().hex}"


def build(docs: DataFrame, folder: str | None = None, shards: int | None = None) -> Trie:
    """Count the texts of ``docs`` (text) and write both levels.

    ``shards`` (a power of two, by default from the number of shuffle partitions) sets how much of the
    model one task builds.
    """
    spark = docs.sparkSession
    wanted = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, wanted - 1).bit_length()
    shards = 1 << bits
    folder = local_folder(spark, folder)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                bodies = raw_texts(batch.column(0))
                for a, b in blocks(bodies, 1 << 21):
                    yield np.unique(token_hashes(bodies[a:b])[0], return_counts=True)
        yield from counted_blocks(found(), lambda k: word_shard(k, bits))

    def write_words(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        base = np.uint64(shard) << np.uint64(64 - bits) if bits else np.uint64(0)
        arrays, facts = coded("hash", EliasFano.encode(keys - base, 1 << (64 - bits)))
        more, facts2 = coded("tokens", EliasFano.encode(np.concatenate(([0], np.cumsum(counts))), int(counts.sum()) + 1))
        save(f"{folder}/words-{shard}", arrays | more, facts | facts2)
        ends = int(counts[keys == END].sum())
        return {"words": len(keys), "tokens": int(counts.sum()), "ends": ends}

    made = {r["shard"]: json.loads(r["facts"]) for r in merged(texts.mapInArrow(count_words, ROWS), shards, write_words)}
    words = [made.get(s, {}).get("words", 0) for s in range(shards)]
    tokens = [made.get(s, {}).get("tokens", 0) for s in range(shards)]
    facts = {"shards": shards, "words": words, "v": sum(words), "n": sum(tokens), "texts": sum(m["ends"] for m in made.values()),
             "first_id": np.concatenate(([0], np.cumsum(words)))[:-1].tolist(),
             "first_token": np.concatenate(([0], np.cumsum(tokens)))[:-1].tolist()}
    trie = Trie(folder, facts)
    if not facts["n"]:
        return trie
    v = np.uint64(facts["v"])

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trie(folder, facts)

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                bodies = raw_texts(batch.column(0))
                for a, b in blocks(bodies, 1 << 21):
                    context, word, _ = numbered(model, bodies[a:b])
                    yield np.unique(context.astype(np.uint64) * v + word.astype(np.uint64), return_counts=True)

        def shard_of(keys: np.ndarray) -> np.ndarray:
            context, word = (keys // v).astype(np.int64), (keys % v).astype(np.int64)
            kinds, where = np.unique(context, return_inverse=True)
            before, counts = mass_of(model, kinds)
            return np.maximum.accumulate(model.pair_shard(before[where], counts[where], word))

        yield from counted_blocks(found(), shard_of)

    def write_pairs(shard: int, keys: np.ndarray, counts: np.ndarray) -> dict:
        model = Trie(folder, facts)
        context = (keys // v).astype(np.int64)
        first, last = int(context[0]), int(context[-1])
        starts = np.searchsorted(context, np.arange(first, last + 2))
        kinds, where = np.unique(context, return_inverse=True)
        _, totals = mass_of(model, kinds)
        share = np.maximum(counts - DISCOUNT, 1e-9) / totals[where]
        codes = np.minimum(np.round(-np.log10(share) * STEPS), 65535).astype(np.uint16)
        base = np.uint64(first) * v
        arrays, info = coded("next", EliasFano.encode(keys - base, int(keys[-1] - base) + 1))
        more, info2 = coded("start", EliasFano.encode(starts, len(keys) + 1))
        save(f"{folder}/pairs-{shard}", arrays | more | {"codes": codes}, info | info2 | {"first_key": int(base), "first_context": first})
        return {"pairs": len(keys)}

    merged(texts.mapInArrow(count_pairs, ROWS), shards, write_pairs)
    return trie


def numbered(model: Trie, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids of each token's context and of the token (-1 unknown, v for the begin of a text), with its look-up."""
    hashes, counts = token_hashes(texts)
    kinds, where = np.unique(hashes, return_inverse=True)
    ids, times, before = model.look_up(kinds)
    word = ids[where]
    context = np.empty(len(word), np.int64)
    context[1:] = word[:-1]
    context[np.cumsum(counts) - counts] = model.facts["v"]
    return context, word, (counts, times[where])


def mass_of(model: Trie, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens before, and count of, ascending context ids."""
    before, counts = np.full(len(contexts), model.facts["n"]), np.full(len(contexts), model.facts["texts"])
    bounds = np.array([*model.facts["first_id"], model.facts["v"]])
    shards = np.searchsorted(bounds, contexts, side="right") - 1
    for s, part in model.by_shard(shards):
        if s < model.shards and model.facts["words"][s]:
            at = contexts[part] - model.facts["first_id"][s]
            tokens = model.words(s)[1]
            low = tokens.access(at).astype(np.int64)
            before[part], counts[part] = low + model.facts["first_token"][s], tokens.access(at + 1).astype(np.int64) - low
    return before, counts


def pair_parts(model: Trie, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(discounted probability of the pair, weight of the lower order) of ascending (context, word) keys."""
    v = np.uint64(model.facts["v"])
    context, word = (keys // v).astype(np.int64), (keys % v).astype(np.int64)
    kinds, where = np.unique(context, return_inverse=True)
    before, counts = mass_of(model, kinds)
    kept = np.zeros(len(keys))
    shards = np.maximum.accumulate(model.pair_shard(before[where], counts[where], word)) if len(keys) else np.empty(0, np.int64)
    for s, part in model.by_shard(shards):
        if (opened := model.pairs(s)) is None:
            continue
        nexts, _, codes, first_key, _ = opened
        inside = keys[part] >= np.uint64(first_key)
        wanted = keys[part][inside] - np.uint64(first_key)
        place = nexts.successor(wanted)
        known = place < nexts.n
        known[known] = nexts.access(place[known]) == wanted[known]
        rows = np.arange(part.start, part.stop)[inside][known]
        kept[rows] = 10.0 ** (-codes[place[known]].astype(float) / STEPS)
    followers = np.zeros(len(kinds))
    lowest, highest = model.pair_shard(before, counts, np.zeros(len(kinds))), model.pair_shard(before, counts, np.full(len(kinds), model.facts["v"]))
    for s in range(int(lowest.min(initial=0)), int(highest.max(initial=-1)) + 1):
        rows = np.flatnonzero((lowest <= s) & (s <= highest))
        if not len(rows) or (opened := model.pairs(s)) is None:
            continue
        starts, first = opened[1], opened[4]
        at = kinds[rows] - first
        rows, at = rows[(at >= 0) & (at < starts.n - 1)], at[(at >= 0) & (at < starts.n - 1)]
        followers[rows] += starts.access(at + 1).astype(float) - starts.access(at).astype(float)
    return kept, (DISCOUNT * followers / np.maximum(counts, 1))[where]


def score_texts(model: Trie, texts: list[bytes]) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text."""
    n, v = model.facts["n"], model.facts["v"]
    context, word, (sizes, times) = numbered(model, texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    rest = DISCOUNT * v / n / (v + 1) if n else 1.0
    single = np.maximum(times - DISCOUNT, 0) / max(n, 1) + rest
    p = single.copy()
    if n:
        known = np.flatnonzero(context >= 0)
        # An unknown word takes the place of word 0 to learn its context's weight; its own part is 0.
        keys = context[known].astype(np.uint64) * np.uint64(v) + np.maximum(word[known], 0).astype(np.uint64)
        kinds, where = np.unique(keys, return_inverse=True)
        kept, weight = pair_parts(model, kinds)
        p[known] = np.where(word[known] >= 0, kept[where], 0) + weight[where] * single[known]
    base = np.log10((times + 1) / (n + v + 1))
    return [sizes, np.bincount(owner, times > 0, len(texts)).astype(np.int64), np.bincount(owner, base, len(texts)),
            np.bincount(owner, np.log10(p), len(texts))]


def score(docs: DataFrame, model: Trie, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    folder, facts = model.folder, model.facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(folder, facts)
        for batch in batches:
            texts = raw_texts(batch.column(2))
            parts = [score_texts(trie, texts[a:b]) for a, b in blocks(texts, 1 << 21)]
            sizes, known, base, total = (np.concatenate(x) for x in zip(*parts)) if parts else [np.empty(0)] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(np.full(len(texts), facts["n"]), pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                  "base_score double, score double")
