"""Word order counts in the quality classifier."""

import random

from veilspark.llm import resampling


def test_shuffled_words_go(spark):
    """Texts of good texts' words in wrong order are told from good texts."""
    draw = random.Random(4)
    after = {w: [draw.randrange(200) for _ in range(3)] for w in range(200)}
    docs, labels = [], []
    for i in range(1200):
        word, words = draw.randrange(200), []
        for _ in range(100):
            words.append(f"w{word}")
            word = draw.choice(after[word])
        good = i % 2
        if not good:
            draw.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, good, 0))
    rows = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"),
                               spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    kept = {g: sum(r["kept"] for r in rows if r["doc_id"] % 2 == g) for g in (0, 1)}
    assert kept[1] > 570 and kept[0] < 30
