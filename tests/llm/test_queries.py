"""The registered queries: against SQL where there is a twin, else against brute force or held-out accuracy."""

import collections
import math
import os
import re
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from compare import compare, database  # noqa: E402
from veilspark.llm import chained_dedup, token_rollups  # noqa: E402
from veilspark.llm.elias_fano import EliasFano  # noqa: E402
from veilspark.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def lowered(text):
    return bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_as_sql(spark, name):
    text, _, ok = compare(spark, database(SF), SF, name)
    assert ok, text


@pytest.mark.parametrize("n,universe", [(0, 9), (1, 5), (1000, 10**6), (1000, 2**63), (50_000, 60_000), (500, 2**20)])
def test_elias_fano(n, universe):
    draw = np.random.default_rng(n).integers(0, universe, n + 2000, dtype=np.uint64)
    values = np.sort(draw[:n])
    coded = EliasFano.encode(values, universe)
    assert (coded.access(np.arange(n)) == values).all() if n else True
    assert (coded.successor(draw) == np.searchsorted(values, draw)).all()


def test_language_model(spark, rows):
    got = {r["doc_id"]: r for r in QUERIES["op3_lm_scoring"](spark, SF).collect()}
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", lowered(r["text"])) + [None] for i, r in rows.items()}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    count = collections.Counter(w for i in train for w in tokens[i])
    pairs = collections.Counter(p for i in train for p in zip([0, *tokens[i]], tokens[i]))
    context, kinds = collections.Counter(), collections.Counter()
    for (v, _), n in pairs.items():
        context[v] += n
        kinds[v] += 1
    n, size = sum(count.values()), len(count)

    def single(w):
        return max(count[w] - 0.75, 0) / n + 0.75 * size / n / (size + 1)

    def pair(v, w):
        return max(pairs[v, w] - 0.75, 0) / context[v] + 0.75 * kinds[v] / context[v] * single(w) if context[v] else single(w)

    total = collections.Counter()
    for i, found in tokens.items():
        g = got[i]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"], g["held_out"]) == (
            len(found), sum(count[w] > 0 for w in found), n, i not in train)
        assert g["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + size + 1)) for w in found))
        assert abs(g["score"] - sum(math.log10(pair(v, w)) for v, w in zip([0, *found], found))) < 2e-4 * len(found)
        if g["held_out"]:
            total.update(base=g["base_score"], model=g["score"])
    assert total["model"] > total["base"]


def test_quality_classifier(spark, labels):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op4_quality_classifier"](spark, SF).collect()}
    good = [kept[i] for i, x in labels.items() if x["quality"] == 1 and not x["toxic"]]
    bad = [kept[i] for i, x in labels.items() if x["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.03


def test_jaccard_join(spark, rows):
    sets, texts, holders = {}, {}, collections.defaultdict(list)
    for i, r in rows.items():
        w = words(r["text"])
        texts[i], sets[i] = b" ".join(w), {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        for x in sets[i]:
            holders[x].append(i)
    shared = collections.Counter((a, b) for v in holders.values() for k, a in enumerate(v) for b in v[k + 1:])
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    root = {i: i for i in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    different = {frozenset((texts[a], texts[b])) for a, b in links if texts[a] != texts[b]}
    degree = collections.Counter(t for pair in different for t in pair)
    got = QUERIES["op5_jaccard_join"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all((r["class_id"], r["n_links"]) == (top(r["doc_id"]), degree[texts[r["doc_id"]]]) for r in got)


def test_large_buckets_join_by_stars(spark):
    """A group of near copies beyond the limit of a bucket stays one group, with fewer pairs than all."""
    from veilspark.llm import jaccard_join
    base = [f"word{i}" for i in range(300)]
    texts = [(i, " ".join([*base[:i % 290], f"other{i}", *base[i % 290 + 1:]])) for i in range(400)]
    apart = [(1000 + i, " ".join(f"x{i}y{j}" for j in range(50))) for i in range(20)]
    docs = spark.createDataFrame(texts + apart, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in jaccard_join.report(docs, limit=32).collect()}
    assert {got[i] for i, _ in texts} == {0} and all(got[i] == i for i, _ in apart)


def test_token_counts(spark, rows, labels):
    import tiktoken
    encode = tiktoken.Encoding("x", pat_str=token_rollups.PATTERN, mergeable_ranks=token_rollups.load_ranks("byte_bpe_50k"),
                               special_tokens={}).encode_ordinary
    want = collections.defaultdict(lambda: [0, 0])
    for i, r in rows.items():
        text = r["text"]
        if i in labels and labels[i]["toxic"] == 1:
            continue
        if i in labels and labels[i]["quality"] == 0:
            text = re.sub(r"[#*$%&|<>!]+", " ", text)
        for name, n in (("words", len(text.encode().split())), ("byte_bpe_50k", len(encode(text)))):
            want[r["source"], r["lang"], name][0] += 1
            want[r["source"], r["lang"], name][1] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == dict(want)


def test_language_id(spark, rows):
    got = QUERIES["op7_language_id"](spark, SF).collect()
    held = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in got if r["held_out"]]
    assert len(got) == len(rows) and len(held) > 200 and np.mean(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_chains_are_best():
    """The Fenwick tree finds the same scores as trying every predecessor."""
    draw = np.random.default_rng(3)
    for _ in range(50):
        places = sorted({(int(x), int(y)) for x, y in draw.integers(0, 120, (30, 2))})
        best = {}
        for x, y in places:
            best[x, y] = 8.0
            for (a, b), value in list(best.items()):
                if a < x and b < y:
                    best[x, y] = max(best[x, y], 8 + value - 0.25 * (x + y - a - b) / 2)
        found = chained_dedup.chains(places)
        assert sorted(p for c in found for p in c) == places
        assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:]))

        def score(chain):
            total = 8.0
            for (a, b), (x, y) in zip(chain, chain[1:]):
                total += 8 - 0.25 * (x + y - a - b) / 2
            return total
        assert score(found[0]) == pytest.approx(max(best.values()))


def exact_repeats(texts, size=50):
    """Word places inside windows that two documents have."""
    holders = collections.defaultdict(list)
    for i, w in texts.items():
        for j in range(len(w) - size + 1):
            holders[b" ".join(w[j:j + size])].append((i, j))
    places = collections.defaultdict(set)
    for v in holders.values():
        if len({i for i, _ in v}) > 1:
            for i, j in v:
                places[i].update(range(j, j + size))
    return places


def test_substring_dedup(spark, rows):
    texts = {i: words(r["text"]) for i, r in rows.items()}
    covered = collections.defaultdict(set)
    for r in QUERIES["op8_substring_dedup"](spark, SF).collect():
        covered[r["doc_id"]].update(range(r["first_word"], r["end_word"]))
        covered[r["other_doc_id"]].update(range(r["other_first_word"], r["other_end_word"]))
    wanted = exact_repeats(texts)
    missed = sum(len(p - covered[i]) for i, p in wanted.items())
    assert missed < 0.002 * sum(map(len, wanted.values())) and set(wanted) <= set(covered)
    left = chained_dedup.without_repeats(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert not exact_repeats({r["doc_id"]: words(r["text"]) for r in left})


def test_fuzzy_passage(spark):
    """A passage with a changed, a dropped and an added word is one passage."""
    passage = [f"p{i * 37 % 101}q{i}" for i in range(120)]
    fuzzy = [*passage[:40], "changed", *passage[41:80], *passage[81:100], "added", *passage[100:]]
    docs = spark.createDataFrame([(1, " ".join([*(f"a{i}" for i in range(30)), *passage])), (2, " ".join([*fuzzy, *(f"b{i}" for i in range(30))]))],
                                 "doc_id long, text string")
    (found,) = chained_dedup.passages(docs).collect()
    spans = {found["doc_id"]: (found["first"], found["last"]), found["other_id"]: (found["other_first"], found["other_last"])}
    assert spans == {1: (30, 150), 2: (0, 120)} and found["n_equal"] == 118


def test_pipeline(spark, rows, labels):
    """Against brute force: no bad documents, no near copies, no shared passages, no benchmark windows, targets met."""
    import corpus_pipeline
    got = corpus_pipeline.run(spark, SF).collect()
    texts = {r["doc_id"]: words(r["text"]) for r in got}
    assert len(texts) == len(got) and set(texts) <= set(rows)
    bad = [i for i in texts if i in labels and labels[i]["quality"] == 0]
    assert len(bad) <= 2 and not exact_repeats(texts)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[j:j + 10]) for j in range(len(w) - 9)}
    assert not any(tuple(w[j:j + 10]) in windows for w in texts.values() for j in range(len(w) - 9))
    assert all(r["copies"] in (1, 2) and r["taken"] == r["copies"] * len(r["text"].encode().split()) for r in got)


def test_components(spark):
    from veilspark.llm.components import components, merged
    chain, star, more = [(i, i + 1) for i in range(60)], [(100, i) for i in range(101, 200)], [(5, 150), (310, 500)]
    links = spark.createDataFrame(chain + star, "a long, b long")
    roots = components(links)
    assert {r["node"]: r["root"] for r in roots.collect()} == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 200), 100)}
    joined = {r["node"]: r["root"] for r in merged(roots, spark.createDataFrame(more, "a long, b long")).collect()}
    assert joined == {**dict.fromkeys([*range(61), *range(100, 200)], 0), 310: 310, 500: 310}
    assert components(links.limit(0)).isEmpty()
