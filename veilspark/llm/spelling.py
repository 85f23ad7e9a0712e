"""Spelling variants: words one edit apart, found by K-d trees over their letter counts.

A replaced letter lowers one letter count by one and raises another, an inserted one raises a single count:
the count vectors of near words differ by at most two in sum.  So a word looks for its near words in boxes of
a K-d tree over the counts of all words of one length: of its own (replacements) and of one more (insertions).
A search box is left as soon as it lies beyond one count too few and one too many.  A replacement is looked for
from the lesser of its two words only, so the count that falls belongs to a lesser letter than the one that
rises, which prunes too, and each pair is found once.  Words that share a leaf are compared letter by letter.

The upper trees, one per length, are built from a sample of the words (``sample`` at most, which only
balances them) and cut all words of a length into cells of about ``cell``; every word goes to one cell to be
found and to all cells that its searches reach.  Cells above ``most`` words, which words of equal letters may
fill, are dealt out by hash, with every search sent to all parts: exact at any size.  In a cell a lower tree of
the same kind is built and searches pass down it as arrays, many at once.

Nulls: a null text has no words; a null document id is written as nothing.  Empty texts have no words, very
long ones and endless words are whole.  Ties: of near words equally frequent the least in code-point order is
the form.  Repeated rows count as often as they come.  An empty table gives an empty result; extra columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions.scaling import cut

from .columns import written
from .words import LOWER, raw_texts

RUN = re.compile("[a-zÀ-ÿ]+")
"""Runs of letters once A-Z are lower-cased."""
MISSPELL = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
LETTERS = np.array([*range(97, 123), *range(0xC0, 0x100)])
SLOT = np.zeros(256, np.int64)
SLOT[LETTERS] = np.arange(len(LETTERS))
NONE_UP = len(LETTERS)
SAMPLE = 200_000
CELL = 4096
MOST = 65_536
LEAF = 32
FLUSH = 500_000
MET = 1 << 20
"""Letters compared at once."""


def spoken(text: bytes, key: bytes) -> Counter[str]:
    """Words of a text with their counts; a run whose hash with the key 97 divides has lost a letter."""
    found: Counter[str] = Counter()
    start = zlib.crc32(key + b":")
    for run, n in Counter(RUN.findall(text.translate(LOWER).decode())).items():
        h = zlib.crc32(run.encode(), start)
        if h % MISSPELL == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LETTERS:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words that occur often enough; tasks add up what they read before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(raw_texts(batch.column(0)), raw_texts(batch.column(1))):
                held.update(spoken(text, key))
                if len(held) > FLUSH:
                    yield rows()
        yield rows()

    chosen = docs.select(F.col(id_column).cast("string").alias("key"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letters_of(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(-1, length)


def counts_of(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    n, length = letters.shape
    flat = np.repeat(np.arange(n) * len(LETTERS), length) + SLOT[letters].ravel()
    return np.bincount(flat, minlength=n * len(LETTERS)).reshape(n, len(LETTERS))


class Tree:
    """A K-d tree over count vectors as flat lists; node i splits at ``count[letter[i]] <= cut[i]``.

    Children below zero are leaves.  A node splits at the letter that varies most, where its halves are most
    alike; vectors that are all equal stay one leaf.
    """

    def __init__(self, counts: np.ndarray, leaf: int):
        self.letter: list[int] = []
        self.cut: list[int] = []
        self.child: list[list[int]] = []
        self.leaves: list[np.ndarray] = []
        open_: list[tuple[np.ndarray, int, int]] = [(np.arange(len(counts)), -1, 0)]
        while open_:
            rows, parent, side = open_.pop()
            part = counts[rows]
            at = int(part.var(axis=0).argmax()) if len(rows) > leaf else 0
            values = part[:, at]
            if len(rows) > leaf and values.min() < values.max():
                below = np.cumsum(np.bincount(values))[values.min():values.max()]
                where = int(np.abs(2 * below - len(rows)).argmin() + values.min())
                name = len(self.letter)
                self.letter.append(at)
                self.cut.append(where)
                self.child.append([0, 0])
                open_ += [(rows[values <= where], name, 0), (rows[values > where], name, 1)]
            else:
                self.leaves.append(rows)
                name = -len(self.leaves)
            if parent >= 0:
                self.child[parent][side] = name
        self.root = 0 if self.letter else -1

    def place(self, counts: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        found = np.zeros(len(counts), np.int64)
        open_ = [(self.root, np.arange(len(counts)))]
        while open_:
            node, rows = open_.pop()
            if node < 0:
                found[rows] = -node - 1
            elif len(rows):
                lower = counts[rows, self.letter[node]] <= self.cut[node]
                open_ += [(self.child[node][0], rows[lower]), (self.child[node][1], rows[~lower])]
        return found

    def reach(self, counts: np.ndarray, longer: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): where words one edit from the given ones may lie, one letter longer or equally long.

        On the way down a search remembers the letter of which the box has one more than the word and, for words
        equally long, the letter of which it has one less; a second such letter ends it.
        """
        n = len(counts)
        open_ = [(self.root, np.arange(n), np.full(n, NONE_UP), np.full(n, -1))]
        while open_:
            node, rows, up, down = open_.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            at = self.letter[node]
            gap = counts[rows, at] - self.cut[node]
            less = (gap == 1) & ((down == -1) | (down == at)) & (up > at) & (not longer)
            fits = (gap <= 0) | less
            open_.append((self.child[node][0], rows[fits], up[fits], np.where(less, at, down)[fits]))
            more = (gap == 0) & ((up == NONE_UP) | (up == at)) & (down < at)
            fits = (gap > 0) | more
            open_.append((self.child[node][1], rows[fits], np.where(more, at, up)[fits], down[fits]))


def one_replaced(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b), a the lesser word, that differ in just one place; rows come as columns."""
    differs = a[:, :, None] != b[:, None, :]
    i, j = np.nonzero(differs.sum(axis=0, dtype=np.int32) == 1)
    at = differs[:, i, j].argmax(axis=0)
    lesser = a[at, i] < b[at, j]
    return i[lesser], j[lesser]


def one_inserted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) where b is a with one more letter; rows come as columns."""
    head = np.logical_and.accumulate(a[:, :, None] == b[:-1, None, :], axis=0).sum(axis=0, dtype=np.int32)
    tail = np.logical_and.accumulate((a[:, :, None] == b[1:, None, :])[::-1], axis=0).sum(axis=0, dtype=np.int32)
    return np.nonzero(head + tail >= len(a))


class Cell:
    """The words of one cell with their tree."""

    def __init__(self, words: list[str]):
        self.length = len(words[0])
        self.letters = letters_of(words, self.length)
        self.tree = Tree(counts_of(self.letters), LEAF)

    def near(self, words: list[str], longer: bool) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): word i of the given ones is one edit from word j of the cell."""
        letters = letters_of(words, self.length - longer)
        match = one_inserted if longer else one_replaced
        found = [(np.empty(0, np.int64),) * 2]
        for leaf, rows in self.tree.reach(counts_of(letters), longer):
            mine = self.tree.leaves[leaf]
            step = max(1, min(len(mine), MET // self.length))
            each = max(1, MET // (self.length * step))
            for first in range(0, len(rows), each):
                part = rows[first:first + each]
                theirs = np.ascontiguousarray(letters[part].T)
                for at in range(0, len(mine), step):
                    some = mine[at:at + step]
                    i, j = match(theirs, np.ascontiguousarray(self.letters[some].T))
                    found.append((part[i], some[j]))
        i, j = (np.concatenate(x) for x in zip(*found))
        return i, j


Trees = dict[int, tuple[Tree, int]]
WHOLE = Tree(np.empty((0, len(LETTERS)), np.int64), 1)
"""A single cell, for lengths of which the sample has no word."""


def upper_trees(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> Trees:
    """Per length the tree that cuts its words into cells, and the number of its first cell."""
    share = min(1.0, sample / max(words.count(), 1))
    by_length: dict[int, list[str]] = {}
    for (word,) in words.sample(share, seed=1).select("word").toLocalIterator() if share < 1 else words.select("word").toLocalIterator():
        by_length.setdefault(len(word), []).append(word)
    trees, first = {}, 0
    for length, some in sorted(by_length.items()):
        tree = Tree(counts_of(letters_of(some, length)), max(8, int(cell * share)))
        trees[length] = (tree, first)
        first += len(tree.leaves)
        tree.leaves = []
    return trees


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, count vectors) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == length)
        yield length, rows, counts_of(letters_of([words[i] for i in rows.tolist()], length))


def routed(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, most: int = MOST) -> DataFrame:
    """(cell, part, kind, word, n): kind 0 lies in the cell, 1 looks there for replacements, 2 for insertions."""
    spark = words.sparkSession
    trees = spark.sparkContext.broadcast(upper_trees(words, sample, cell))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            for length, rows, counts in by_length(batch.column(0).to_pylist()):
                tree, first = trees.value.get(length, (WHOLE, -length))
                found[rows] = first + tree.place(counts)
            yield pa.RecordBatch.from_arrays([pa.array(found)], ["cell"])

    sizes = words.select("word").mapInArrow(placed, "cell long").groupBy("cell").count().filter(F.col("count") > most)
    parts = {r["cell"]: -(-r["count"] // most) for r in sizes.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            made: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

            def add(rows: np.ndarray, cell: int, kind: int) -> None:
                for part in range(parts.get(cell, 1)):
                    made.append((rows, np.full(len(rows), cell), np.full(len(rows), part), kind))

            for length, rows, counts in by_length(words):
                tree, first = trees.value.get(length, (WHOLE, -length))
                cells = first + tree.place(counts)
                dealt = np.array([zlib.crc32(words[i].encode()) % parts.get(c, 1) for i, c in zip(rows.tolist(), cells.tolist())], np.int64)
                made.append((rows, cells, dealt, 0))
                for leaf, some in tree.reach(counts, False):
                    add(rows[some], first + leaf, 1)
                tree, first = trees.value.get(length + 1, (WHOLE, -length - 1))
                for leaf, some in tree.reach(counts, True):
                    add(rows[some], first + leaf, 2)
            if made:
                rows, cells, dealt = (np.concatenate(x) for x in list(zip(*made))[:3])
                kinds = np.repeat([kind for *_, kind in made], [len(x) for x, *_ in made])
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(dealt), pa.array(kinds.astype(np.int32)), *taken.columns],
                                                 ["cell", "part", "kind", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell long, part long, kind int, word string, n long")


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL, most: int = MOST) -> DataFrame:
    """(word, near, near_n): each pair of near words once in either direction."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                cell, part, kind = keys[a].tolist()
                some = batch.slice(a, b - a).select(["word", "n"])
                if (cell, part) != here:
                    here, held, tree = (cell, part), [], None
                if kind == 0:
                    held.append(some)
                elif held:
                    if tree is None:
                        mine = pa.Table.from_batches(held).combine_chunks()
                        tree = Cell(mine.column("word").to_pylist())
                    i, j = tree.near(some.column(0).to_pylist(), kind == 2)
                    left, right = pa.Table.from_batches([some]).take(pa.array(i)), mine.take(pa.array(j))
                    for x, y in ((left, right), (right, left)):
                        yield from pa.table([x.column("word"), y.column("word"), y.column("n")], ["word", "near", "near_n"]).to_batches()

    dealt = routed(words, sample, cell, most).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    return dealt.mapInArrow(run, "word string, near string, near_n long")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms ends; the steps double with each round."""
    up = written(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        up = written(up.join(next_, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        if up.filter("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST_COUNT, ratio: float = RATIO,
             sample: int = SAMPLE, cell: int = CELL, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word: its most frequent near word, if ``ratio`` times as frequent."""
    words = cut(vocabulary(docs, id_column, text_column, least))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    found = near_words(words, sample, cell, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    told = cut(words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"),
        F.when(fits, -F.col("best.minus")).alias("form_n")))
    rooted = told.join(last_forms(told.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
