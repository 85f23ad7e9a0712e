"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import LONG, ODD
from veilspark.llm import (balance, chained_dedup, decontaminate, jaccard_join, language_id, license_scan, ngram_trie, quality_rules,
                           resampling, token_rollups)

N_LONG = len(LONG.split())


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three"), (2, None), (None, "wörter über"), (1, "one two three")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def crowded(odd):
    """Extra columns whose names operators might use themselves."""
    for name in ("n_words", "kept", "copies", "taken", "size", "g", "rate", "_words", "doc", "class", "score", "_doc_key", "_spans"):
        odd = odd.withColumn(name, F.lit("mine"))
    return odd


def by_text(rows, column):
    return {(r["doc_id"], r["n_words"]): r[column] for r in rows}


def test_quality_rules(odd, empty, crowded):
    rows = quality_rules.judge(odd).collect()
    assert len(rows) == len(ODD)
    assert sorted(r["n_words"] for r in rows) == sorted(len((t or "").split()) for _, t, *_ in ODD)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.filter_documents(crowded).columns == crowded.columns
    quality_rules.filter_documents(crowded).collect()


def test_decontamination(odd, empty, benchmark, crowded):
    rows = decontaminate.scan(odd, benchmark).collect()
    hit = {(r["doc_id"], r["n_words"]): (r["n_hit"], r["items"]) for r in rows}
    assert len(rows) == len(ODD) and hit[None, 3] == (3, ["1"]) and hit[8, 5] == (2, [""]) and hit[1, 0] == (0, [])
    assert hit[5, N_LONG] == (0, [])
    assert decontaminate.scan(empty, benchmark).count() == 0
    assert not decontaminate.scan(odd, benchmark.limit(0)).filter("contaminated").count()
    cleaned = decontaminate.clean(crowded, benchmark, max_coverage=0.5)
    assert cleaned.columns == crowded.columns
    texts = {(r["doc_id"], r["text"]) for r in cleaned.collect()}
    assert (None, "one two three") not in texts and (1, None) in texts and (8, "Ünïcode  alles ß") in texts


def test_language_model(odd, empty):
    held = language_id.held_out(parts=7)
    rows = ngram_trie.score(odd, ngram_trie.build(odd.filter(~held), shards=4), held).collect()
    assert len(rows) == len(ODD) and all(r["n_tokens"] >= 1 and r["score"] < 0 for r in rows)
    assert max(r["n_tokens"] for r in rows) == N_LONG + 1
    nothing = ngram_trie.build(empty)
    assert {r["score"] for r in ngram_trie.score(odd, nothing, held).collect()} == {0.0}
    assert ngram_trie.score(empty, nothing, held).count() == 0


def test_quality_classifier(odd, empty, labels, crowded):
    rows = resampling.resample(odd, labels).collect()
    assert len(rows) == len(ODD)
    assert all(r["kept"] for r in resampling.resample(odd, labels.limit(0)).collect())
    assert resampling.resample(empty, labels).count() == 0
    kept = resampling.keep(crowded.drop("_doc_key"), labels)
    assert kept.columns == crowded.drop("_doc_key").columns and kept.count() <= len(ODD)


def test_jaccard_join(odd, empty, crowded):
    rows = jaccard_join.report(odd.select("doc_id", "text")).collect()
    assert len(rows) == len(ODD)
    assert {r["class_id"] for r in rows if r["doc_id"] in (6, 7)} == {6}
    assert all(r["copies"] == 3 for r in rows if r["doc_id"] in (6, 7)) and all(r["n_links"] == 0 for r in rows)
    assert jaccard_join.report(empty.select("doc_id", "text")).count() == 0
    single = jaccard_join.one_of_each(crowded.drop("_doc_key"))
    assert single.columns == crowded.drop("_doc_key").columns
    assert sorted(str(r["text"])[:9] for r in single.select("text").collect()) == sorted(
        {("" if not t else t)[:9] for _, t, *_ in ODD if t} | {"None"})


def test_token_counts(spark, odd, tmp_path):
    rollup = token_rollups.Rollup(spark, f"file://{tmp_path}/r", vocabularies=())
    assert rollup.commit("1", odd.withColumn("op", F.lit("insert"))) and not rollup.commit("1", odd.withColumn("op", F.lit("insert")))
    total = sum(r["n_tokens"] for r in rollup.totals().collect())
    assert total == sum(len((t or "").split()) for _, t, *_ in ODD)
    gone = spark.createDataFrame([("delete", 6, None, None, None), ("revise", 8, "ein Wort", "de", "c"), ("delete", 99, None, None, None),
                                  ("delete", None, None, None, None)], "op string, doc_id long, text string, lang string, source string")
    rollup.commit("2", gone)
    rollup.commit("2", gone)
    left = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert left["c", "de"] == (1, 2) and left["b", "en"] == (1, 6) and left["a", "en"] == (2, N_LONG)
    rollup.commit("3", gone.limit(0))
    assert rollup.committed() == ["1", "2", "3"]


def test_language_id(odd, empty):
    model = language_id.fit(odd.select("lang", "text"))
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, model).collect()}
    assert (8, "de") in found and (6, "en") in found and (1, "und") in found and (4, "und") in found
    nothing = language_id.fit(empty.select("lang", "text"))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify(odd, nothing).collect()} == {("und", 0.0)}
    assert language_id.identify(empty, model).count() == 0


def test_language_of_numerals(documents, odd):
    """A text without a letter has no language, whatever its numerals and marks."""
    model = language_id.fit(odd.select("lang", "text"))
    rows = [(1, "½ ² Ⅷ ٣ 12", None, None, 0), (2, "² m²", None, None, 0), (3, "\u0301 \u0308", None, None, 0)]
    found = {r["doc_id"]: r for r in language_id.identify(documents(rows), model).collect()}
    assert (found[1]["lang_pred"], found[1]["score"]) == ("und", 0.0) == (found[3]["lang_pred"], found[3]["score"])
    assert found[2]["lang_pred"] != "und"


def test_substring_dedup(odd, empty, crowded):
    assert chained_dedup.passages(odd.select("doc_id", "text")).count() == 0
    assert chained_dedup.passages(empty.select("doc_id", "text")).count() == 0
    plain = crowded.drop("_spans")
    rows = chained_dedup.without_repeats(plain)
    assert rows.columns == plain.columns
    assert sorted(str(r["text"]) for r in rows.select("text").collect()) == sorted(str(t) for _, t, *_ in ODD)


def test_license_scan(spark, odd, empty):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == len(ODD) and all(r["labels"] == "" and r["score"] == 0 and r["first_word"] is None for r in rows)
    assert license_scan.scan(empty).count() == 0
    texts = spark.createDataFrame([(1, "x Licensed under the Apache License, Version 2.0. CC-BY-NC 4.0"), (2, "MIT License " * 3)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(texts).collect()}
    assert found[1]["labels"] == "apache,cc-by,cc-by-nc" and found[1]["base_labels"] == "apache,cc-by" and found[1]["first_word"] == 4
    assert found[2]["n_base"] == 3 and found[2]["last_word"] == 4 and found[2]["labels"] == "mit"


def test_mixing(odd, empty, crowded):
    rows = balance.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["source_size"] for r in rows if r["source"] is None} == {3}
    assert balance.mix(empty).count() == 0
    mixed = balance.mix_documents(crowded)
    assert mixed.columns[:len(crowded.columns)] == crowded.columns and len(mixed.columns) == len(crowded.columns) + 2
    mixed.collect()


def test_pipeline_stages(spark, odd, empty, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([(6, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd, empty):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert set(odd.columns) < set(docs.columns)
        docs.collect()
