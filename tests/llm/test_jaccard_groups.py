"""Groups of many sets that are just similar enough, against brute force."""

import random

from veilspark.llm import jaccard_join


def test_runs_for_deep_splits():
    """Runs grow with the splits it takes to make a bucket small."""
    assert jaccard_join.runs_for(0.8, 0.9999) == 10
    for splits in range(1, 6):
        assert (1 - 0.8 ** splits) ** jaccard_join.runs_for(0.8, 0.9999, splits) <= 1e-4


def test_group_at_the_threshold(spark):
    """Hundreds of sets at similarities of 0.80 to 0.85 are the groups that all pairs give."""
    draw, texts = random.Random(5), []
    for group in range(2):
        base = [f"g{group}w{i}" for i in range(275)]
        for i in range(350):
            words = list(base)
            for place in draw.sample(range(5, 270, 6), 3):
                words[place] = f"o{draw.randrange(10**9)}"
            texts.append((group * 1000 + i, " ".join(words)))
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (t.split() for _, t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {texts[i][0]: texts[top(i)][0] for i in range(len(texts))}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.report(docs, limit=16).collect()}
    assert got == want


def test_links_of_a_crowd_are_all_counted(spark):
    """Sets of buckets that no split makes small have as many links as all pairs give, in one block and in many."""
    draw, texts = random.Random(6), []
    base = [f"w{i}" for i in range(120)]
    for i in range(150):
        words = list(base)
        for place in draw.sample(range(5, 115, 5), draw.randrange(4)):
            words[place] = f"o{draw.randrange(10**9)}"
        texts.append((i, " ".join(words)))
    sets = {t: {tuple(w[j:j + 5]) for j in range(len(w) - 4)} for t in {t for _, t in texts} for w in [t.split()]}
    linked = {t: sum(len(a & b) >= 0.8 * len(a | b) for u, b in sets.items() if u != t) for t, a in sets.items()}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (256, 20):
        got = {r["doc_id"]: r["n_links"] for r in jaccard_join.report(docs, limit=16, block=block).collect()}
        assert got == {i: linked[t] for i, t in texts}


def test_tree_of_links():
    """A tree connects what all links connect."""
    import numpy as np
    linked = np.zeros((6, 5), bool)
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1), (3, 4), (4, 4), (4, 3)):
        linked[i, j] = True
    edges = jaccard_join.tree_of(linked)
    assert all(linked[i, j] for i, j in edges) and len(edges) == 3 + 3
    assert {i for i, _ in edges} == {0, 1, 3, 4} and {j for _, j in edges} == {0, 1, 3, 4}
