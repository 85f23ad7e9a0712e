"""Table scans, column alignment, table sizes and result sinks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RelationalSchema

Tables = Mapping[str, DataFrame]


def load_tables(spark: SparkSession, schema: RelationalSchema, root: str,
                fmt: str = "csv", types: Mapping[str, T.StructType] | None = None) -> dict[str, DataFrame] | None:
    """One scan per declared table at ``root/<table>.<fmt>``, or None unless all of them exist.

    CSV columns take the physical types of ``types`` where given; a value that does not parse is an error.
    Other tables' types are inferred from all their rows, in one more pass.
    """
    tables = {}
    for name in schema.tables:
        reader = spark.read
        try:
            if fmt == "csv":
                reader = reader.option("header", True).option("mode", "FAILFAST")
                declared = (types or {}).get(name)
                if declared is not None:
                    by_name = {f.name: f for f in declared.fields}
                    header = spark.read.option("header", True).csv(f"{root}/{name}.csv").columns
                    reader = reader.schema(T.StructType([by_name.get(h, T.StructField(h, T.StringType())) for h in header]))
                else:
                    reader = reader.option("inferSchema", True)
            df = reader.format(fmt).load(f"{root}/{name}.{fmt}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        tables[name] = df
    return align_all(tables, schema)


def align_columns(df: DataFrame, attributes: list[str] | tuple[str, ...]) -> DataFrame:
    """Declared columns that exist, in declared order."""
    return df.select([c for c in attributes if c in df.columns])


def align_all(tables: Tables, schema: RelationalSchema) -> dict[str, DataFrame]:
    return {n: align_columns(tables[n], t.attributes) for n, t in schema.tables.items()}


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_sizes(tables: Tables) -> DataFrame:
    """(table_name, n_rows) of all tables in one job; Parquet answers it from file footers."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n_rows"))
                     .select(F.lit(name).alias("table_name"), "n_rows")
                      for name, df in tables.items()])


def collect_sizes(tables: Tables) -> dict[str, int]:
    return {r["table_name"]: r["n_rows"] for r in table_sizes(tables).collect()}


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested struct fields as top-level columns with dotted names."""
    def leaves(dtype: T.DataType, path: list[str]) -> list[Column]:
        if isinstance(dtype, T.StructType):
            return [leaf for f in dtype.fields for leaf in leaves(f.dataType, [*path, f.name])]
        return [F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path))]
    return df.select([leaf for f in df.schema.fields for leaf in leaves(f.dataType, [f.name])])


def flatten_record(record: Mapping, prefix: str = "") -> dict:
    """The same for one nested dictionary."""
    flat = {}
    for key, value in record.items():
        name = f"{prefix}.{key}" if prefix else str(key)
        flat.update(flatten_record(value, name) if isinstance(value, Mapping) else {name: value})
    return flat


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write result rows as csv, json or parquet, from the executors."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    elif fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    else:
        raise ValueError(f"unknown result format {fmt!r}")
