"""Ingest of foreign Markdown files with a header."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import frontmatter
from docloom.session import ship_package

YAML_BLOCK = r"(?s)\A---\n(.*?)\n---\n"
READ = T.StructType([
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])


@F.pandas_udf(READ)
def _read_yaml(headers: pd.Series) -> pd.DataFrame:
    import yaml

    def read(header):
        if header is None:
            return None, None
        try:
            value = yaml.safe_load(header)
        except yaml.YAMLError:
            return None, None
        if value is None:
            return None, None
        if not isinstance(value, dict):
            return None, "frontmatter is not a mapping"
        return {str(k): None if v is None else str(v) for k, v in value.items()}, None

    return pd.DataFrame([read(h) for h in headers], columns=["fields", "error"])


def parse_yaml(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``fields`` and ``error`` from a YAML header; broken YAML gives no fields."""
    ship_package(files.sparkSession)
    header = F.when(
        F.regexp_like(F.col(content), F.lit(YAML_BLOCK)), F.regexp_extract(content, YAML_BLOCK, 1)
    )
    return files.withColumn("_read", _read_yaml(header)).select(
        *files.columns, "_read.fields", "_read.error"
    )


def parse_plain(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``fields`` and ``body`` by the plain ``key: value`` reader."""
    return files.withColumn("fields", frontmatter.fields(F.col(content))).withColumn(
        "body", frontmatter.body(F.col(content))
    )
