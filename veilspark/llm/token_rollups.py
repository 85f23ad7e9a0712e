"""Token counts as delta-maintained rollups by source, language and tokenizer version.

Changes arrive in batches of (op, doc_id, text, source, lang): an insert adds a document, a delete takes
all it had counted away, a revise does both with the new text.  A batch becomes signed ledger entries
per document and tokenizer version, and from them signed totals; both are additive, so the rollup is a
sum over committed batches, and removing a document needs only its own ledger entries.

A batch is one folder in each table, written whole; the totals' _SUCCESS file, written last, commits it.
A batch that is already committed is left alone, a broken one is overwritten, so any batch can be sent
again.  Counting streams over texts; only counts are shuffled, summed on the map side first, so a source
with most of the rows is a few rows per task.

Defined results: null and empty texts count 0 tokens and one document; null sources, languages and ids
are values of their own; repeated inserts count repeatedly and one delete removes them all; deleting an
unknown document does nothing; extra columns are ignored; an empty batch commits empty totals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the split pattern of the 50k byte-pair vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ("source", "lang", "tokenizer")


def load_ranks(name: str, folder: str = TOKENIZERS) -> dict[bytes, int]:
    """A byte-pair vocabulary: token bytes to rank."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Rollup:
    """A rollup in a shared folder.  ``vocabularies`` are the byte-pair versions counted beside ``words``."""

    def __init__(self, spark: SparkSession, path: str, vocabularies: tuple[str, ...] = ("byte_bpe_50k",), folder: str = TOKENIZERS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.ranks = spark.sparkContext.broadcast({name: load_ranks(name, folder) for name in vocabularies})

    def committed(self) -> list[str]:
        """Names of the committed batches, in order."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals")
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(top):
            return []
        names = [s.getPath().getName() for s in files.listStatus(top)]
        return sorted(n.removeprefix("batch=") for n in names
                      if n.startswith("batch=") and files.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/totals/{n}/_SUCCESS")))

    def read(self, table: str, batches: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{table}/batch={b}" for b in batches])

    def counted(self, changes: DataFrame) -> DataFrame:
        """(doc_id, source, lang, tokenizer, n_tokens) of the texts of inserts and revisions."""
        shared = self.ranks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoders = {name: tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
                        for name, ranks in shared.value.items()}
            for batch in batches:
                texts = [t or "" for t in batch.column(3).to_pylist()]
                counts = {"words": [len(t.encode().split()) for t in texts]}
                counts |= {name: [len(encode(t)) for t in texts] for name, encode in encoders.items()}
                for name, column in counts.items():
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([name] * len(texts), pa.string()), pa.array(column, pa.int64())],
                                                     ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

        chosen = changes.filter(F.col("op").isin("insert", "revise")).select("doc_id", "source", "lang", "text")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:3])
        return chosen.mapInArrow(run, f"{kinds}, tokenizer string, n_tokens long")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        done = self.committed()
        if batch in done:
            return False
        added = self.counted(changes).withColumn("n_docs", F.lit(1).cast("long"))
        entries = added.select("doc_id", *KEYS, "n_docs", "n_tokens")
        if done:
            gone = changes.filter(F.col("op").isin("delete", "revise")).select(F.col("doc_id").alias("_gone")).distinct()
            held = self.read("ledger", done).join(gone, F.col("doc_id").eqNullSafe(F.col("_gone"))).drop("_gone")
            now = held.groupBy("doc_id", *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
            entries = entries.unionByName(now.select("doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens")))
        entries.write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        summed = self.read("ledger", [batch]).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens over all committed batches."""
        rows = self.read("totals", self.committed()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.filter("n_docs <> 0 OR n_tokens <> 0")
