"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

All items go into one automaton of word ids.  A document's words walk through it; at each word the
automaton knows the longest suffix that some item contains.  Where that suffix is at least a window
long, the window's words are hit and the state tells the items that contain it.  Items shorter than a
window are windows of their own.  The automaton is broadcast; its size is checked: benchmarks beyond
``MAX_WORDS`` are cut into several automata of whole items, applied one after the other.

Every document is judged alone in one streaming pass: no shuffle, no matter how many share a passage.

Defined results: null and empty texts have no words; items without words are ignored; items with a
null id count as one item with an empty name; repeated items count once; repeated documents get equal
rows; with an empty benchmark nothing is hit; ``clean`` keeps extra columns whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, raw_texts

WINDOW = 10
MAX_WORDS = 2_000_000
"""Words of one automaton: some hundred bytes each on the driver and on every Python worker."""
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Automaton:
    """Suffix automaton of several word sequences; states keep the items whose window ends there."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, dict[int, set[str]]] = {}
        self.least = min([window, *(len(words) for _, words in items if words)])
        numbered = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items]
        for _, ids in numbered:
            last = 0
            for at in ids:
                last = self._extend(last, at)
        for name, ids in numbered:
            self._mark(ids, name)

    def _extend(self, last: int, c: int) -> int:
        """Append a word to the sequence that ends in state ``last``."""
        if c in self.next[last]:
            known = self.next[last][c]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        state = self._add({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return state

    def _add(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        twin = self._add(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _mark(self, ids: list[int], name: str) -> None:
        """Note the item at the state of each of its windows; states must be final."""
        size = min(self.window, len(ids))
        for state in self._ends(ids, size):
            self.items.setdefault(state, {}).setdefault(size, set()).add(name)

    def _ends(self, ids: list[int], size: int) -> Iterator[int]:
        state, length = 0, 0
        for c in ids if size else ():
            while c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state, length = self.next[state][c], length + 1
            while self.length[self.link[state]] >= size:
                state = self.link[state]
                length = self.length[state]
            if length >= size:
                yield state

    def hits(self, words: Sequence[bytes]) -> list[tuple[int, int, set[str]]]:
        """(first word, size, items) of every window occurrence among the words."""
        lookup = self.ids.get
        ids = np.array([lookup(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        found = []
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if stop - start >= self.least:
                self._walk(ids[start:stop].tolist(), start, found)
        return found

    def _walk(self, ids: list[int], start: int, found: list[tuple[int, int, set[str]]]) -> None:
        state, length = 0, 0
        for i, c in enumerate(ids, start + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(c, 0)
            length = length + 1 if state else 0
            if length >= self.least:
                at = state
                while at > 0:
                    for size, names in self.items.get(at, {}).items():
                        if self.length[self.link[at]] < size <= length:
                            found.append((i - size, size, names))
                    at = self.link[at]


def build(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text",
          max_words: int = MAX_WORDS) -> list[Automaton]:
    """One automaton per ``max_words`` words of items; one empty automaton for an empty benchmark."""
    shards: list[list] = [[]]
    total = 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).distinct()
    for name, body in rows.toLocalIterator():
        words = (body or "").encode().translate(ALNUM).split()
        if not words:
            continue
        if total and total + len(words) > max_words:
            shards.append([])
            total = 0
        shards[-1].append((name, words))
        total += len(words)
    return [Automaton(sorted(shard), window) for shard in shards]


def mask(hits: list[tuple[int, int, set[str]]], n: int) -> np.ndarray:
    """Which of n words lie in a hit window."""
    change = np.zeros(n + 1, np.int32)
    for start, size, _ in hits:
        change[start] += 1
        change[start + size] -= 1
    return np.cumsum(change[:n]) > 0


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
         item: str = "item_id", item_text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    spark = docs.sparkSession
    models = [spark.sparkContext.broadcast(a) for a in build(benchmark, window, item, item_text, max_words)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in raw_texts(batch.column(1)):
                words = body.translate(ALNUM).split()
                hits = [h for m in models for h in m.value.hits(words)]
                names = sorted(set().union(*(names for _, _, names in hits)))
                rows.append((len(words), int(mask(hits, len(words)).sum()), len(names),
                             hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hits), names))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()))
            made = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_words", "n_hit", "n_items",
                                                                        "items_sha256", "contaminated", "items"])

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(judge, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, "
                                    "contaminated boolean, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_length: int | None = None,
          max_coverage: float = 0.5, text: str = "text", item: str = "item_id", item_text: str = "text",
          max_words: int = MAX_WORDS) -> DataFrame:
    """The documents without benchmark passages, in the input's columns.

    A document with more hit words than ``max_length`` (if given), or a larger share than
    ``max_coverage``, goes.  From the others the hit words are cut out, with what stands between
    them; that repeats until the joined rest has no window either.
    """
    spark = docs.sparkSession
    models = [spark.sparkContext.broadcast(a) for a in build(benchmark, window, item, item_text, max_words)]
    place = docs.columns.index(text)

    def cut_out(body: bytes) -> bytes | None:
        total = hit = 0
        while True:
            words = body.translate(ALNUM).split()
            hits = [h for m in models for h in m.value.hits(words)]
            if not hits:
                return body
            marked = mask(hits, len(words))
            hit += int(marked.sum())
            total = total or len(words)
            if hit > max_coverage * total or (max_length is not None and hit > max_length):
                return None
            spans = [m.span() for m in WORD.finditer(body)]
            pieces, at = [], 0
            for i in np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)) == 1):
                stop = i
                while stop + 1 < len(marked) and marked[stop + 1]:
                    stop += 1
                pieces.append(body[at:spans[i][0]])
                at = spans[stop][1]
            body = b"".join([*pieces, body[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            bodies = column.cast(pa.binary()).to_pylist()
            cleaned = [None if b is None else cut_out(b) for b in bodies]
            keep = pa.array([b is None or c is not None for b, c in zip(bodies, cleaned)], pa.bool_())
            new = pa.array([None if c is None else c.decode() for c in cleaned], pa.string()).cast(column.type)
            columns = [new if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(run, docs.schema)
