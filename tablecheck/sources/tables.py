"""Tables, texts and dictionaries from files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_of(path: str) -> str:
    """``csv`` for paths that end in ``.csv``, with or without slashes behind, else ``parquet``."""
    return "csv" if path.rstrip("/").endswith(".csv") else "parquet"


def read_table(
    spark: SparkSession, path: str, *, fmt: str | None = None, sep: str = ";",
    header: bool | None = None, infer_schema: bool | None = None,
    schema: T.StructType | str | None = None, **options,
) -> DataFrame:
    """A table whose format follows from its own path: ``.csv`` is delimited text, anything
    else Parquet.

    Without ``infer_schema`` or ``schema`` delimited columns are text. Inference reads the
    files once more; on large inputs give a schema.
    """
    if fmt is None:
        fmt = format_of(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        return reader.csv(
            path, sep=sep, header=header, inferSchema=infer_schema, nanValue="", **options
        )
    return reader.format(fmt).options(**options).load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: one row per file, whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def read_dictionary(spark: SparkSession, path: str, *, as_object: bool = False) -> DataFrame:
    """``(term, token)`` from JSON lines, or from one ``{term: token}`` object per file.

    A missing path gives an empty dictionary.
    """
    schema = "term string, token string"
    try:
        if not as_object:
            return spark.read.schema(schema).json(path)
        names = F.from_json("value", "map<string,string>")
        return spark.read.text(path, wholetext=True).select(F.explode(names).alias("term", "token"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
