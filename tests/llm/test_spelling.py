"""Spelling variants against comparing all words, with cells of every size, and on odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from veilspark.llm import spelling

LETTERS = "abcdeéÀÿ"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    """(word, form, root, n, n_near, form_n) of all words."""
    form, made = {}, {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        made[w] = (n, len(others), -others[0][0] if form[w] else None)
    def root(w):
        return root(form[w]) if form[w] else w
    return {(w, form[w], root(w), *made[w]) for w in words}


@pytest.fixture(scope="module")
def words():
    """Crowded short words, anagrams, and long words with variants."""
    draw = random.Random(2)
    made = {"".join(draw.choices(LETTERS, k=draw.randint(5, 6))) for _ in range(900)}
    made |= {"".join(draw.sample("abcdef", 6)) for _ in range(300)}
    stem = "".join(draw.choices(LETTERS, k=300))
    made |= {stem[:i] + stem[i + 1:] for i in range(0, 300, 7)} | {stem[:i] + "x" + stem[i:] for i in range(0, 300, 9)} | {stem}
    return {w: draw.choice([3, 4, 7, 9, 20, 100, 400]) for w in sorted(made)}


@pytest.mark.parametrize("sample,cell,most", [(200_000, 4096, 65_536), (200_000, 40, 65_536), (150, 16, 12), (1, 1, 5)])
def test_near_words(spark, words, sample, cell, most):
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3).cache()
    got = [tuple(r) for r in spelling.near_words(table, sample, cell, most).collect()]
    want = {(a, b, m) for a in words for b, m in words.items() if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want


def test_forms_and_roots(spark, words):
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counted = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert {tuple(r) for r in spelling.variants(docs).collect()} == brute(counted)


def test_misspelt_runs():
    text = "Straße ÀB ab xyzzy xyzzy WORDS words déjà÷vu 12ab"
    want = {}
    for i in range(400):
        found = spelling.spoken(text.encode(), str(i).encode())
        for run, n in (("straße", 1), ("xyzzy", 2), ("words", 2), ("déjà÷vu", 1), ("Àb", 1)):
            h = zlib.crc32(f"{i}:{run}".encode())
            kept = run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]
            want[kept] = want.get(kept, 0) + 1
            assert found[kept] == (n if len(kept) >= 5 else 0)
    assert {"straße", "déjà÷vu", "Àb"} < set(want) and len(want) > 8


def test_odd_rows(odd, empty):
    crowded = odd
    for name in ("word", "n", "cell", "part", "kind", "near", "form", "root", "key"):
        crowded = crowded.withColumn(name, F.lit("mine"))
    got = {r["word"]: r for r in spelling.variants(crowded).collect()}
    assert got["again"]["n"] == 2 * sum(t == "the same words again and again" for _, t, *_ in ODD)
    assert all(r["n_near"] == 0 and r["root"] == r["word"] for r in got.values())
    assert spelling.variants(empty).count() == 0


def test_giant_texts(documents):
    endless = "ab" * 500_000
    rows = [(i, f"{endless} {endless}c and " + "hello " * 100_000, None, None, 0) for i in range(3)]
    got = {r["word"]: r for r in spelling.variants(documents(rows)).collect()}
    assert got["hello"]["n"] >= 200_000
    assert {len(w) for w in got} >= {5}
