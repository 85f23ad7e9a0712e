"""The keyword gate keeps every text with a signature, whatever separates the words."""

import re

from veilspark.llm import license_scan

SAYS = {
    "All rights reserved": "proprietary", "released into the public domain": "public-domain", "public domain dedication": "public-domain",
    "Creative Commons Attribution Share Alike": "cc-by-sa", "Creative Commons Zero": "cc0", "ASL 2 0": "apache", "CC BY SA": "cc-by,cc-by-sa",
    "proprietary and confidential": "proprietary"}


def test_separators(spark):
    rows = [(i, "Some words, " + says.replace(" ", glue) + " and more.", label)
            for i, (says, label, glue) in enumerate((s, label, g) for s, label in SAYS.items() for g in (" ", "\n", "\r\n", "-", "  ", "\t", ".", "\u0020\n# "))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    found = {r["doc_id"]: (r["labels"], r["score"] > 0) for r in license_scan.scan(docs).collect()}
    assert found == {i: (label, True) for i, _, label in rows}


def test_every_rule_has_a_keyword():
    """Every branch of every signature and base phrase has a keyword inside one word, or is a cc by name."""
    for pattern in [r[1] for r in license_scan.RULES] + [phrase for phrase, _ in license_scan.BASE]:
        needed = pattern
        while re.search(r"\([^()]*\)\??", needed):
            needed = re.sub(r"\([^()]*\)\??", " ", needed)
        needed = pattern.replace("licen[sc]e", "license") if "licen[sc]e" in pattern else needed
        assert any(k in word for k in license_scan.KEYWORDS for word in needed.split()) or needed.startswith("cc by") or "cc by" in needed \
            or "(?:cc0|zero)" in pattern, pattern
