"""Aggregate and cube sinks (S6, S7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from filingscope.operators.cube import CubeDims


def write_aggregate(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Small aggregate exports: a single CSV part with a header (or Parquet).

    The rows move to one task after the aggregation, which itself stays parallel.
    """
    w = df.repartition(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


#: Quotes are doubled, and a line break stays inside its quotes.
EXPORT_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_exports(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of CSV files in its own order; large ones are written by several tasks."""
    for name, df in tables.items():
        df.write.mode("overwrite").options(**EXPORT_OPTIONS).csv(f"{path}/{name}")


def read_export(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.options(**EXPORT_OPTIONS, multiLine=True).schema(schema).csv(f"{path}/{name}")


def write_cube(facts: DataFrame, dims: CubeDims, meta: DataFrame | None, path: str) -> None:
    """Cube facts and dimensions as Parquet tables, employer metadata as JSON lines."""
    facts.write.mode("overwrite").parquet(f"{path}/facts")
    dims.occupations.write.mode("overwrite").parquet(f"{path}/occupations")
    dims.employers.write.mode("overwrite").parquet(f"{path}/employers")
    dims.states.write.mode("overwrite").parquet(f"{path}/states")
    dims.sectors.write.mode("overwrite").parquet(f"{path}/sectors")
    if meta is not None:
        meta.write.mode("overwrite").json(f"{path}/employer_meta")


def write_cube_document(cubes: dict[str, tuple[CubeDims, DataFrame]], coverage: DataFrame, yoy: DataFrame,
                        employer_meta: DataFrame, path: str) -> None:
    """The whole dashboard document: each dataset's lookups and facts, coverage, year over year, employer metadata."""
    for name, (dims, facts) in cubes.items():
        write_cube(facts, dims, None, f"{path}/{name}")
    coverage.write.mode("overwrite").json(f"{path}/coverage")
    yoy.write.mode("overwrite").json(f"{path}/yoy")
    employer_meta.write.mode("overwrite").json(f"{path}/employer_meta")
