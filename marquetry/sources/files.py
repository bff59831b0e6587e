"""Typed readers, inventories, and sinks that never overwrite."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.functions.contracts import ContractError
from marquetry.functions.hashing import canonical_json_bytes, semantic_sha256, table_digest

INTERACTIONS = "user_id string, item_id string, playtime_forever double, playtime_2weeks double"


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header under a fixed schema; blank is null, `NA` stays text; pruned to `columns`."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files under a path, from listings alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def peek(spark: SparkSession, path: str) -> DataFrame:
    """(path, head) of each text file: the first record found of every file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("_k"), "value")
    return lines.groupBy("path").agg(F.min_by("value", "_k").alias("head"))


def keys_of_json(df: DataFrame, column: str) -> DataFrame:
    """(key, rows) of the top-level keys of a JSON text column."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("rows"))


def load_json(text: str) -> dict[str, Any]:
    """An object from JSON text; repeated keys, NaN and roots of another kind are errors."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ContractError("repeated key")
        return dict(items)

    def constant(name):
        raise ContractError(f"{name} is no JSON number")

    out = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(out, dict):
        raise ContractError("the root is no object")
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """Write a small file whole: to a name of its own first, then renamed; an existing target is an error."""
    fs, target = _path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    _, staged = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(body))
    out.close()
    if not fs.rename(staged, target):
        fs.delete(staged, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file


def write_manifest(spark: SparkSession, path: str, manifest: dict[str, Any]) -> str:
    """Canonical JSON with its own digest under `manifest_id`; returns the digest."""
    body = {k: v for k, v in manifest.items() if k != "manifest_id"}
    digest = semantic_sha256(body)
    write_bytes(spark, path, canonical_json_bytes(body | {"manifest_id": digest}))
    return digest


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any]:
    """A manifest whose digest holds."""
    out = load_json(read_text(spark, path))
    if semantic_sha256({k: v for k, v in out.items() if k != "manifest_id"}) != out.get("manifest_id"):
        raise ContractError(f"{path} does not match its digest")
    return out


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], about: dict[str, Any] | None = None) -> dict[str, Any]:
    """Write tables as Parquet and their manifest to a staging folder and rename it to `folder`, so that both appear at once.

    Nothing is overwritten; a failure leaves no trace at `folder`, so the next try starts afresh. The manifest holds row
    counts and digests that do not depend on row order.
    """
    fs, target = _path(spark, folder)
    if fs.exists(target):
        raise FileExistsError(folder)
    staging = f"{folder}.{uuid.uuid4().hex}"
    entries = {}
    try:
        for name, df in tables.items():
            df.write.parquet(f"{staging}/{name}")
            rows, digest = table_digest(spark.read.parquet(f"{staging}/{name}")).first()
            entries[name] = {"rows": rows, "digest": digest, "columns": [list(c) for c in df.dtypes]}
        manifest = {"tables": entries, "about": about or {}}
        write_manifest(spark, f"{staging}/manifest.json", manifest)
        if fs.exists(target) or not fs.rename(_path(spark, staging)[1], target):
            raise FileExistsError(folder)
    except BaseException:
        fs.delete(_path(spark, staging)[1], True)
        raise
    return manifest


def load_published(spark: SparkSession, folder: str, name: str, verify: bool = True) -> DataFrame:
    """A published table; with verify its rows and digest must match the manifest."""
    entry = read_manifest(spark, f"{folder}/manifest.json")["tables"].get(name)
    if entry is None:
        raise ContractError(f"{folder} has no table {name}")
    df = spark.read.parquet(f"{folder}/{name}")
    if verify and tuple(table_digest(df).first()) != (entry["rows"], entry["digest"]):
        raise ContractError(f"{folder}/{name} does not match its manifest")
    return df


def verify_published(spark: SparkSession, folder: str) -> dict[str, int]:
    """Rows of every table of a folder, all checked against the manifest; unlisted tables are errors."""
    entries = read_manifest(spark, f"{folder}/manifest.json")["tables"]
    fs, p = _path(spark, folder)
    listed = {s.getPath().getName() for s in fs.listStatus(p)} - {"manifest.json", ".manifest.json.crc"}
    if listed != set(entries):
        raise ContractError(f"unlisted or missing: {sorted(listed ^ set(entries))}")
    return {name: load_published(spark, folder, name).count() for name in entries}


def write_csv(df: DataFrame, path: str, crlf: bool = False) -> None:
    """A small report as one CSV part with a header."""
    df.coalesce(1).write.option("header", True).option("lineSep", "\r\n" if crlf else "\n").csv(path)


def redaction_leaks(manifest: Any, at: str = "$") -> list[str]:
    """Places in a manifest that hold absolute paths, home folders or e-mail addresses."""
    if isinstance(manifest, dict):
        return [x for k, v in manifest.items() for x in redaction_leaks(v, f"{at}.{k}")]
    if isinstance(manifest, (list, tuple)):
        return [x for k, v in enumerate(manifest) for x in redaction_leaks(v, f"{at}[{k}]")]
    bad = isinstance(manifest, str) and re.search(r"^/|^[A-Za-z]:\\|/home/|/Users/|[\w.]+@[\w.]+\.\w+", manifest)
    return [at] if bad else []


def bytes_sha256(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()
