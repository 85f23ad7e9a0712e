"""Conversation repair against trying all edits, and on odd rows; the whole table is held against SQL elsewhere."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.llm import conversation_repair as repair

KIND = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
TEXTS = ("Yes.", "No!", "cut off", "", " \n", "ok?", "half")
ROLES = ("user", "assistant", "system", "tool", "")


def brute(rows):
    """Cost, audit and hash of the cheapest edits, over all sequences with few insertions."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None)
        seen.add((role, text))
    best = None
    slots = len(rows) + 1
    for edits in itertools.product(*[("D",) if f in ("blank", "duplicate") else ("D", "K", "R") for f in faults]):
        for added in range(3):
            for where in itertools.combinations_with_replacement(range(slots), added):
                options, audit, cost = [], "", 0
                for i in range(slots):
                    n = where.count(i)
                    options += [[("user", ""), ("assistant", "")]] * n
                    audit, cost = audit + "I" * n, cost + 5 * n
                    if i < len(rows):
                        audit += edits[i]
                        cost += {"D": 2, "K": 0, "R": 1}[edits[i]] + 5 * (edits[i] != "D" and faults[i] == "truncated")
                        if edits[i] != "D":
                            options.append([(rows[i][1], rows[i][2])] if edits[i] == "K" else [("user", rows[i][2]), ("assistant", rows[i][2])])
                if best is not None and (cost, audit) >= best[:2]:
                    continue
                for messages in itertools.product(*options):
                    if GOOD.fullmatch("".join(role[:1] or " " for role, _ in messages)):
                        best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())
                        break
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), *best)


@pytest.fixture(scope="module")
def random_rows():
    draw = random.Random(3)
    made = []
    for conv in range(60):
        for _ in range(draw.randint(1, 4)):
            made.append((conv, draw.choice([None, *range(7)]), draw.choice(ROLES), draw.choice(TEXTS) + draw.choice(["", "a.", "b"])))
    return made


def test_every_edit_tried(spark, random_rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(spark.createDataFrame(random_rows, KIND).repartition(7)).collect()}
    for conv in {r[0] for r in random_rows}:
        assert got[conv] == brute([r[1:] for r in random_rows if r[0] == conv]), conv


def test_repaired_rows_have_the_structure(spark, random_rows):
    rows = repair.repaired(spark.createDataFrame(random_rows, KIND)).collect()
    chats = {}
    for r in rows:
        chats.setdefault(r["conv"], []).append(r["role"][:1])
    assert chats and all(GOOD.fullmatch("".join(x)) for x in chats.values())


def test_giant_conversation_in_many_batches(spark):
    """One conversation longer than many Arrow batches, with texts of several MB in it."""
    n = 30_001
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.col("id").cast("string"), F.when(F.col("id") == 77, F.repeat(F.lit("ab "), 1_000_000)).otherwise(""), F.lit(".")).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        (got,) = repair.report(rows).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (got["cost"], got["gaps"], got["illegal"]) == (2, 0, 0) and len(got["audit"]) == n and got["audit"].count("D") == 1


def test_nulls_ties_and_vanished(spark):
    rows = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "Hi."), (1, 5, "user", "Hi."), (1, 5, "user", "Hi."),
                                  (1, -2**63, "assistant", "Hi."), (1, 2**63 - 1, None, "x.")], KIND)
    of = rows.select("conv_id").union(spark.createDataFrame([(9,)], "conv_id long"))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(rows, of=of).collect()}
    assert got[None] == brute([(None, " ", " "), (1, "user", "Hi.")])
    assert got[9] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[1][0] == 2**63 - 1 and got[1][2] == 1
    none = rows.limit(0)
    assert repair.report(none).count() == 0 and repair.report(repair.damaged(none), of=none).count() == 0


def test_clashing_columns(spark, random_rows):
    rows = spark.createDataFrame(random_rows, KIND)
    crowded = rows
    for name in ("conv", "was", "nth", "fault", "code", "edit", "name", "audit", "cost"):
        crowded = crowded.withColumn(name, F.lit("mine"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(repair.report(crowded, of=crowded)) == key(repair.report(rows, of=rows))
    assert key(repair.damaged(crowded)) == key(repair.damaged(rows))
