"""License scans: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

Texts become words (A-Z lower-cased; runs of letters, digits and non-ASCII characters).  A signature
is a regular expression over words joined by single blanks, anchored at its first, literal word; it
spans at most ``REACH`` words, so the words after an anchor are all a rule has to see.  A projection
finds the anchors, matches the rules of each anchor word and suppresses overlapping detections: one
that lies inside another of higher priority, or of equal priority and greater length or earlier rule,
goes.  Texts without any keyword of the prefilter skip all that.  Rows never meet: no shuffle.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows give equal
rows; extra columns are dropped by ``scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import GAP, TOKEN, bind

REACH = 24
VERSION = r"(?: (?:version|v) ?[0-9]+(?: [0-9]+)?| v?[0-9]+(?: [0-9]+)?)?(?: (?:only|or later|or any later version))?"

# License families and the word sequences that name them.
FAMILIES = (
    ("agpl", "(?:gnu )?affero general public licen[sc]e"), ("agpl", "agpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[sc]e"), ("lgpl", "lgpl"),
    ("gpl", "gnu (?:general public licen[sc]e|gpl|public licen[sc]e)"), ("gpl", "general public licen[sc]e"), ("gpl", "gpl"),
    ("gfdl", "(?:gnu )?free documentation licen[sc]e"),
    ("apache", "apache (?:software )?licen[sc]e"), ("apache", "asl 2 0"),
    ("mit", "mit(?: x11)? licen[sc]e"), ("mit", "expat licen[sc]e"), ("x11", "x11 licen[sc]e"),
    ("bsd-2-clause", "(?:simplified|freebsd) bsd(?: licen[sc]e)?"), ("bsd-2-clause", "bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-2-clause", "2 clause bsd(?: licen[sc]e)?"), ("bsd-3-clause", "(?:new|modified|revised) bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd 3 clause(?: licen[sc]e)?"), ("bsd-3-clause", "3 clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", "original bsd(?: licen[sc]e)?"), ("bsd", "bsd(?: style)? licen[sc]e"),
    ("cc-by-nc-nd", "cc by nc nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc", "cc by nc"), ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"), ("cc-by", "cc by"), ("cc0", "cc0"), ("cc0", "creative commons (?:cc0|zero)"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by", "creative commons attribution"),
    ("mpl", "mozilla public licen[sc]e"), ("mpl", "mpl"), ("epl", "eclipse public licen[sc]e"),
    ("cddl", "common development and distribution licen[sc]e"), ("cddl", "cddl"), ("cpl", "common public licen[sc]e"),
    ("eupl", "european union public licen[sc]e"), ("eupl", "eupl"), ("isc", "isc licen[sc]e"),
    ("zlib", "zlib(?: libpng)? licen[sc]e"), ("bsl", "boost software licen[sc]e"),
    ("busl", "business source licen[sc]e"), ("sspl", "server side public licen[sc]e"),
    ("artistic", "(?:perl )?artistic licen[sc]e"), ("psf", "python software foundation licen[sc]e"),
    ("postgresql", "postgresql licen[sc]e"), ("openssl", "openssl licen[sc]e"), ("ofl", "(?:sil )?open font licen[sc]e"),
    ("odbl", "open (?:data commons )?(?:open )?database licen[sc]e"), ("odc-by", "open data commons attribution licen[sc]e"),
    ("wtfpl", "wtfpl"), ("unlicense", "unlicense"), ("ms-pl", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft reciprocal licen[sc]e"), ("ncsa", "university of illinois ncsa(?: open source)? licen[sc]e"),
    ("upl", "universal permissive licen[sc]e"), ("vim", "vim licen[sc]e"), ("php", "php licen[sc]e"), ("ruby", "ruby licen[sc]e"),
    ("openrail", "openrail(?: m)?(?: licen[sc]e)?"), ("llama-community", "llama [0-9 ]*community licen[sc]e"),
)
GRANTS = ("licensed under", "released under", "distributed under", "available under", "published under", "provided under",
          "covered by", "subject to", "governed by", "offered under")
OTHERS = (
    ("mit", 8, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 8, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 8, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("unlicense", 8, "this is free and unencumbered software released into the public domain"),
    ("public-domain", 6, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 5, "public domain dedication"),
    ("proprietary", 4, "all rights reserved"),
    ("proprietary", 6, "proprietary and confidential"),
)
# The phrases of the base and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# One word, or part of one, of every signature: words are joined by any separators, so a keyword never has two.
KEYWORDS = ("licen", "gpl", "bsd", "cc0", "commons", "wtfpl", "mpl", "cddl", "eupl", "openrail", "asl",
            "permission", "redistribution", "domain", "reserved", "proprietary", "unencumbered", "spdx")
GLUE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def signature_rules() -> list[tuple[str, str, str, int, int]]:
    """(anchor, pattern, label, priority, order): names, SPDX tags and grants of every family, then the rest.

    Patterns that open with an alternative are split so that each starts with one literal word.
    """
    found: list[tuple[str, str, int]] = []
    for label, name in FAMILIES:
        found.append((name + VERSION, label, 5))
        found += [(f"{grant} (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}{VERSION}", label, 7) for grant in GRANTS]
        found.append((f"spdx license identifier {name}{VERSION}", label, 9))
    found += [(pattern, label, priority) for label, priority, pattern in OTHERS]
    rules = []
    for pattern, label, priority in found:
        for opened in opened_up(pattern):
            rules.append((anchor_of(opened), opened, label, priority, len(rules)))
    return rules


def opened_up(pattern: str) -> list[str]:
    """The pattern without leading alternatives or options: one variant for each branch."""
    if not pattern.startswith("(?:"):
        return [pattern]
    body, rest = pattern[3:].split(")", 1)
    variants = [branch + rest.removeprefix("?") for branch in body.split("|")] + ([rest[1:]] if rest.startswith("?") else [])
    return [opened for variant in variants for opened in opened_up(variant.strip())]


def anchor_of(pattern: str) -> str:
    """The literal first word of a signature."""
    word = ""
    for c in pattern:
        if not c.isalnum():
            break
        word += c
    return word


RULES = signature_rules()
MOST = max(sum(r[0] == a for r in RULES) for a in {r[0] for r in RULES})


def scanned_words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(TOKEN), F.lit(0))


def gate(text: Column) -> Column:
    """True for every text with a signature or base phrase, and for few others."""
    low = F.lower(F.coalesce(text, F.lit("")))
    some = F.lit(False)
    for word in KEYWORDS:
        some |= low.contains(word)
    return some | (low.contains("cc") & low.rlike("cc" + GLUE + "by"))


def rule_table() -> Column:
    """Map from anchor word to its rules, as a literal."""
    by_anchor: dict[str, list[str]] = {}
    for anchor, pattern, label, priority, order in RULES:
        by_anchor.setdefault(anchor, []).append(
            f"named_struct('re', r'^(?:{pattern})( |$)', 'label', '{label}', 'priority', {priority}, 'order', {order})")
    return F.expr("map(" + ", ".join(f"'{a}', array({', '.join(rules)})" for a, rules in sorted(by_anchor.items())) + ")")


def detections(words: Column) -> Column:
    """All rule matches as (start, stop, priority, order, label), in order of their start."""
    anchors = sorted({r[0] for r in RULES})
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())

    def match(i: Column) -> Column:
        context = F.array_join(F.slice(words, i + 1, REACH), " ")
        rules = F.element_at(rule_table(), F.get(words, i))
        def hit(c: Column, r: Column) -> Column:
            return bind(F.trim(F.call_function("regexp_extract", c, r["re"], F.lit(0))), lambda m: F.struct(
                i.alias("start"), (i + F.size(F.split(m, " "))).alias("stop"), r["priority"].alias("priority"),
                r["order"].alias("order"), r["label"].alias("label"), (m != "").alias("found")))

        return bind(context, lambda c: F.filter(F.transform(rules, lambda r: hit(c, r)), lambda x: x["found"]))

    return F.flatten(F.transform(at, match))


def unsuppressed(hits: Column) -> Column:
    """Hits that no other hit contains with precedence.  Containing hits start within REACH words, and a
    position has at most as many hits as its anchor has rules, so a bounded slice holds all of them."""
    near = REACH * MOST

    def beats(g: Column, h: Column) -> Column:
        inside = (g["start"] <= h["start"]) & (g["stop"] >= h["stop"]) & (g["order"] != h["order"])
        longer = (g["stop"] - g["start"]) - (h["stop"] - h["start"])
        return inside & ((g["priority"] > h["priority"]) | ((g["priority"] == h["priority"]) & (
            (longer > 0) | ((longer == 0) & (g["order"] < h["order"])))))

    return bind(hits, lambda all_hits: F.filter(all_hits, lambda h, k: ~F.exists(
        F.slice(all_hits, F.greatest(F.lit(1), k + 1 - near), F.lit(2 * near)), lambda g: beats(g, h))))


def base_places(words: Column) -> Column:
    """Places of the base phrases as (start, label)."""
    firsts = [phrase.split()[0] for phrase, _ in BASE]
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(firsts), i)), lambda i: i.isNotNull())

    def label(i: Column) -> Column:
        found = F.lit(None).cast("string")
        for phrase, name in BASE:
            n = len(phrase.split())
            found = F.coalesce(F.when(F.array_join(F.slice(words, i + 1, n), " ") == phrase, F.lit(name)), found)
        return F.struct(i.alias("start"), found.alias("label"))

    return F.filter(F.transform(at, label), lambda x: x["label"].isNotNull())


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id with counts, base places, labels, score and the detections themselves."""
    none = F.expr("CAST(array() AS array<string>)")
    gated = df.select(F.col(key).alias("doc_id"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAP), "")).cast("long").alias("n_words"),
                      F.when(gate(F.col(text)), scanned_words(F.col(text))).alias("_words"))
    found = (gated.withColumn("_base", F.when(F.col("_words").isNotNull(), base_places(F.col("_words"))))
             .withColumn("detections", F.when(F.col("_words").isNotNull(), unsuppressed(detections(F.col("_words"))))).drop("_words"))
    base, own = F.coalesce(F.col("_base.label"), none), F.coalesce(F.col("detections.label"), none)
    best = F.coalesce(F.array_max(F.col("detections.priority")) / 10, F.lit(0.0))
    return found.select("doc_id", "n_words", F.greatest(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
                        F.array_min("_base.start").cast("long").alias("first_word"), F.array_max("_base.start").cast("long").alias("last_word"),
                        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), best.alias("score"), "detections")
