"""Records written as one Python literal per line (single quotes, None, u''), which is not JSON."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shaped(value, kind: T.DataType):
    """The value under a Spark type: missing fields null, numbers as text where text is asked for."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in value] if isinstance(value, (list, tuple)) else None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(value) if not isinstance(value, str) else None
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return int(value) if not isinstance(value, str) else None
    return value


def parse_literals(lines: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Rows of the schema from a `value` column of literals; blank lines are skipped.

    Strict: a line that does not parse, or is no mapping, fails the job with its text's head. Permissive: such lines give a
    row of nulls with the error in `_error`. Literals only are read; nothing is evaluated.
    """
    out = T.StructType([*schema.fields, *([] if strict else [T.StructField("_error", T.StringType())])])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["value"]:
                if text is None or not text.strip():
                    continue
                try:
                    record = ast.literal_eval(text.strip())
                    if not isinstance(record, dict):
                        raise ValueError(f"a {type(record).__name__}, not a mapping")
                    row, error = _shaped(record, schema), None
                except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
                    if strict:
                        raise ValueError(f"bad record {text[:80]!r}: {e}") from e
                    row, error = {}, str(e)
                rows.append({f.name: row.get(f.name) for f in schema.fields} | ({} if strict else {"_error": error}))
            yield pd.DataFrame(rows, columns=[f.name for f in out.fields], dtype=object)

    return lines.select("value").mapInPandas(parse, out)


def read_literals(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    return parse_literals(spark.read.text(path), schema, strict)


LIBRARY = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("steam_id", T.StringType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_name", T.StringType()), T.StructField("playtime_forever", T.DoubleType()), T.StructField("playtime_2weeks", T.DoubleType())]))),
    ]
)
BUNDLE = T.StructType(
    [
        *[T.StructField(f"bundle_{n}", T.StringType()) for n in ("id", "name", "url", "price", "final_price", "discount")],
        T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("item_id", "item_name", "discounted_price", "genre", "item_url")]))),
    ]
)
CATALOGUE = T.StructType([*[T.StructField(n, T.StringType()) for n in ("id", "app_name", "title", "price", "publisher", "developer", "release_date")], T.StructField("genres", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType()))])


def exploded_items(bundles: DataFrame) -> DataFrame:
    """One row per bundle component."""
    return bundles.select("bundle_id", F.posexplode_outer("items").alias("position", "item")).select("bundle_id", "position", "item.*")
