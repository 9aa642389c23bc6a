"""Sources and sinks with schemas, resumable appends, digests and provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def schema_problems(df: DataFrame, schema: StructType, allow_extra: bool = False) -> list[str]:
    """All ways in which df departs from the schema: missing, extra and mistyped columns, and nulls where none may be. Nulls are counted in one pass."""
    has, want = {f.name: f for f in df.schema}, {f.name: f for f in schema}
    out = [f"missing column {n}" for n in want if n not in has]
    out += [] if allow_extra else [f"extra column {n}" for n in has if n not in want]
    out += [f"column {n} is {has[n].dataType.simpleString()}, not {f.dataType.simpleString()}" for n, f in want.items() if n in has and has[n].dataType != f.dataType]
    full = [n for n, f in want.items() if n in has and not f.nullable]
    if full:
        nulls = df.agg(*[F.count(F.when(F.col(f"`{n}`").isNull(), 1)).alias(n) for n in full]).first()
        out += [f"column {n} has {nulls[n]} nulls" for n in full if nulls[n]]
    return out


def check_schema(df: DataFrame, schema: StructType, allow_extra: bool = False) -> DataFrame:
    """df's columns in the schema's order (then others); raises ValueError with every problem at once."""
    if problems := schema_problems(df, schema, allow_extra):
        raise ValueError("; ".join(problems))
    named = [f.name for f in schema]
    return df.select(*[F.col(f"`{n}`") for n in [*named, *[c for c in df.columns if c not in named]]])


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A scan with filter and columns, both of which reach the reader."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, schema: StructType, allow_extra: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    check_schema(df, schema, allow_extra).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, schema: StructType) -> None:
    """Numbers are written so that they read back the same."""
    check_schema(df, schema).write.mode("overwrite").option("header", True).csv(path)


def load(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A table by its suffix: csv, json or parquet (also without a suffix)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        if schema is None:
            raise ValueError("csv needs a schema")
        return read_csv(spark, path, schema)
    if kind in ("json", "jsonl", "geojson"):
        return (spark.read.schema(schema) if schema else spark.read).option("multiLine", kind == "geojson").json(path)
    return spark.read.parquet(path)


def fold_assignment(spark: SparkSession, path: str, folds: int, schema: StructType | None = None) -> DataFrame:
    """parcel_id, fold_id of a table; raises ValueError where a fold is none of 1 to `folds`."""
    df = load(spark, path, schema).select("parcel_id", F.col("fold_id").cast("int").alias("fold_id"))
    bad = [r["fold_id"] for r in df.where(F.col("fold_id").isNull() | ~F.col("fold_id").between(1, folds)).select("fold_id").distinct().limit(20).collect()]
    if bad:
        raise ValueError(f"unknown folds: {sorted(bad, key=str)}")
    return df


def block_assignment(df: DataFrame) -> DataFrame:
    """parcel_id, bootstrap_id of labelled parcels, in order."""
    return df.where("ogf IS NOT NULL").select("parcel_id", F.col("bootstrap_id").cast("int").alias("bootstrap_id")).orderBy("parcel_id")


def to_json(data: object) -> str:
    """The same text for equal data: keys sorted, two spaces of indent."""
    return json.dumps(data, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def pending(specs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The specs that no done row has, for runs that resume."""
    return specs.join(done.select(*keys).distinct(), keys, "left_anti")


def append_pending(spark: SparkSession, results: DataFrame, path: str, keys: list[str]) -> None:
    """Append the rows whose keys the table at path lacks; running it twice changes nothing."""
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        results = pending(results, spark.read.parquet(path), keys)
    results.write.mode("append").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per keys: new's, where it has one. Ties within one side go to the greatest row."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max(F.struct("_o", *rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, n_bytes and sha256 of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status of each recorded or present file (path, n_bytes, sha256): ok, size, digest, missing or unrecorded."""
    a = actual.select("path", F.col("n_bytes").alias("n2"), F.col("sha256").alias("s2"), F.lit(True).alias("here"))
    both = recorded.withColumn("told", F.lit(True)).join(a, "path", "full")
    status = F.when(F.col("told").isNull(), "unrecorded").when(F.col("here").isNull(), "missing").when(F.col("n_bytes") != F.col("n2"), "size").when(F.col("sha256") != F.col("s2"), "digest").otherwise("ok")
    return both.select("path", status.alias("status"))


def max_gap(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: n_common, n_only_one and gap, the largest absolute difference over shared keys."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r")), keys, "full")
    shared = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(F.count(F.when(shared, 1)).alias("n_common"), F.count(F.when(~shared, 1)).alias("n_only_one"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("gap"))
