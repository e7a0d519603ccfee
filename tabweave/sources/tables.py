"""Tables in and out: formats, train/test pairs, the processed-feature cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json")


def _format(path: str, kind: str | None) -> str:
    if kind is None:
        stem = path.rstrip("/").lower()
        kind = next((f for f in FORMATS if stem.endswith("." + f)), "parquet")
    if kind not in FORMATS:
        raise ValueError(f"unknown format '{kind}'; choose from {FORMATS}")
    return kind


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A CSV (with header), Parquet or JSON table.

    Without a schema CSV types are inferred, which reads the files once more; pass one at scale.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = _format(path, kind)
    if kind == "csv":
        options = {"header": True, "inferSchema": schema is None, "escape": '"', "multiLine": False} | options
    return reader.options(**options).format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str | None = None, mode: str = "overwrite") -> None:
    kind = _format(path, kind)
    writer = df.write.mode(mode)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(kind).save(path)


def _first_matching(spark: SparkSession, directory: str, word: str, kind: str) -> str | None:
    """First file or folder, by name, whose stem holds the word in any case."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(directory)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = sorted(f.getPath().getName() for f in files)
    hits = [n for n in names if n.lower().endswith("." + kind) and word in n[: -len(kind) - 1].lower()]
    return f"{directory.rstrip('/')}/{hits[0]}" if hits else None


def read_pair(
    spark: SparkSession,
    directory: str | None = None,
    train: str | None = None,
    test: str | None = None,
    kind: str | None = None,
    schema: T.StructType | str | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Train and test tables, by path or found by name in a directory; the test may be absent."""
    if directory is not None:
        wanted = kind or "csv"
        train = train or _first_matching(spark, directory, "train", wanted)
        test = test or _first_matching(spark, directory, "test", wanted)
    if train is None:
        raise FileNotFoundError("no train table found")
    first = read_table(spark, train, kind, schema)
    if test is None:
        return first, None
    return first, read_table(spark, test, kind, _schema_for(spark, test, kind, schema))


def _schema_for(spark: SparkSession, path: str, kind: str | None, schema: T.StructType | str | None) -> T.StructType | str | None:
    """The schema for a table that may lack columns. CSV goes by place, so its header picks and orders the fields."""
    if schema is None or _format(path, kind) != "csv":
        return schema
    known = {f.name: f for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields}
    names = spark.read.option("header", True).option("escape", '"').csv(path).columns
    return T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in names])


def write_feature_cache(train: DataFrame, test: DataFrame | None, path: str) -> None:
    write_table(train, f"{path}/train", "parquet")
    if test is not None:
        write_table(test, f"{path}/test", "parquet")


def read_feature_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    train = spark.read.parquet(f"{path}/train")
    try:
        return train, spark.read.parquet(f"{path}/test")
    except Exception as error:  # the path is absent in train-only runs
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return train, None


def prediction_name(keep: tuple[str, ...], task: str, target: str | None) -> str:
    """Column for predictions: the last kept column if it is the target, else ``prediction``."""
    if task == "classification" and keep and keep[-1] == target:
        return keep[-1]
    return "prediction"


def predictions_table(df: DataFrame, keep: tuple[str, ...], name: str, prediction: str = "prediction") -> DataFrame:
    """Kept columns and the prediction under its output name."""
    kept = [c for c in keep if c in df.columns and c != name]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{prediction}`").alias(name))
