"""Language identification: known words by frequency, unseen words by ever shorter character n-grams.

The model counts words and character n-grams per language.  A word's score in a language is its log
frequency; a word the model has not seen is scored by its n-grams of the greatest length of which it
knows any, down to single letters.  A text's scores are the sums over its words; the language with
the highest sum wins (the first by name among equals) and the softmax of the sums is its score.

The model is fitted on a bounded sample of labelled rows (``sample`` per language, chosen by a hash)
and holds at most ``max_words`` words and ``max_grams`` n-grams of each length per language, so its
broadcast is bounded.  Every text is predicted whole in one streaming pass without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if
nothing was learned; repeated rows get equal rows; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilspark.functions.scaling import cut

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
SAMPLE = 5_000
MAX_WORDS = 50_000
MAX_GRAMS = 20_000
CACHE = 500_000


def split_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters; numerals such as ½ or Ⅷ may stand in a word but make none."""
    runs = WORD.findall(text.lower()) if text else []
    return [w for w in runs if w.isalpha() or any(c.isalpha() for c in w)]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between blanks; single letters without them."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies per language of known words (n = 0) and of n-grams: a row number per entry, one matrix per n."""

    def __init__(self, languages: list[str], tables: dict[int, dict[str, list[float]]]) -> None:
        self.languages = languages
        self.index = {n: {entry: i for i, entry in enumerate(table)} for n, table in tables.items()}
        self.logs = {n: np.array(list(table.values()), float).reshape(len(table), len(languages)) for n, table in tables.items()}

    def back_off(self, word: str) -> np.ndarray:
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            known = [i for i in map(self.index[n].get, grams_of(word, n)) if i is not None]
            if known:
                return self.logs[n][known].sum(axis=0) / len(known)
        return np.zeros(len(self.languages))

    def predict(self, texts: list[str | None], unseen: dict[str, np.ndarray]) -> list[tuple[str, float]]:
        """Language and score of each text; ``unseen`` remembers words scored by n-grams."""
        row, found = self.index[0].get, []
        for text in texts:
            words = split_words(text)
            if not words or not self.languages:
                found.append(("und", 0.0))
                continue
            rows = [row(w, -1) for w in words]
            total = self.logs[0][[i for i in rows if i >= 0]].sum(axis=0)
            for word, i in zip(words, rows):
                if i < 0:
                    vector = unseen.get(word)
                    if vector is None:
                        if len(unseen) >= CACHE:
                            unseen.clear()
                        vector = unseen[word] = self.back_off(word)
                    total = total + vector
            best = int(np.argmax(total))
            found.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return found


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows of (lang, text) per language, by a hash of the text."""
    rates = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("rate"))
    unit = F.pmod(F.xxhash64("text", F.lit("lang")), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(cut(rates)), "lang").filter(unit < F.col("rate")).select("lang", "text")


def fit(rows: DataFrame, sample: int = SAMPLE, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Fit on (lang, text) rows; rows without a language or text teach nothing."""
    usable = sampled(rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()), sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(split_words(text))
        for lang, counted in words.items():
            yield from told(lang, 0, counted)
            for n in range(1, LONGEST + 1):
                grams: Counter = Counter()
                for word, times in counted.items():
                    for g in grams_of(word, n):
                        grams[g] += times
                yield from told(lang, n, grams)

    def told(lang: str, n: int, counted: Counter) -> Iterator[pa.RecordBatch]:
        items = list(counted.items())
        for i in range(0, len(items), 50_000):
            part = items[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([n] * len(part), pa.int32()),
                                              pa.array([k for k, _ in part], pa.string()), pa.array([v for _, v in part], pa.int64())],
                                             ["lang", "n", "gram", "times"])

    counts = cut(usable.mapInArrow(count, "lang string, n int, gram string, times long")
                 .groupBy("lang", "n", "gram").agg(F.sum("times").alias("times")))
    sizes = {(r["lang"], r["n"]): (r["total"], r["kinds"]) for r in
             counts.groupBy("lang", "n").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds")).collect()}
    rank = F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("times"), "gram"))
    kept = counts.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
    languages = sorted({lang for lang, _ in sizes})
    place = {lang: i for i, lang in enumerate(languages)}
    tables: dict[int, dict[str, list[float]]] = {n: {} for n in range(LONGEST + 1)}
    # An entry that a language lacks scores alike in all languages: as half a count in the one with the most text.
    floors = {n: float(np.log(0.5 / (1.0 + max((sum(sizes[x]) for x in sizes if x[1] == n), default=0)))) for n in tables}
    for r in kept.drop("rank").toLocalIterator():
        total, kinds = sizes[r["lang"], r["n"]]
        row = tables[r["n"]].setdefault(r["gram"], [floors[r["n"]]] * len(languages))
        row[place[r["lang"]]] = float(np.log((r["times"] + 0.5) / (total + kinds + 1.0)))
    return Model(languages, tables)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unseen: dict[str, np.ndarray] = {}
        for batch in batches:
            found = shared.value.predict(batch.column(2).to_pylist(), unseen)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()),
                                              pa.array([x for _, x in found], pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def held_out(key: str = "doc_id", parts: int = 4):
    """Documents left out of fitting: the CRC of the id leaves 2; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == 2
