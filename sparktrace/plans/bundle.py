"""Saved analyses: parquet tables with a manifest that is written last and names what it holds."""

from __future__ import annotations

import csv
import hashlib
import json
import sys
import time
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

MANIFEST = "manifest.json"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(rows: DataFrame) -> dict:
    """Number of rows and an order-free digest of them."""
    digest = F.xxhash64(*[F.col(c) if not t.startswith("map") else F.to_json(c) for c, t in rows.dtypes])
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(digest), F.lit(0)).alias("x"), F.coalesce(F.sum(F.pmod(digest, F.lit(1 << 31))), F.lit(0)).alias("s")).first()
    return {"rows": r.n, "digest": f"{r.x & (1 << 64) - 1:016x}{r.s:016x}", "columns": rows.columns}


class Writer:
    """Tables written one by one to a staging folder and read from there, so that what follows doesn't compute them again; commit puts all in place."""

    def __init__(self, spark: SparkSession, path: str, overwrite: bool = False, progress: bool = False):
        self.spark, self.path, self.progress, self.began = spark, path.rstrip("/"), progress, time.time()
        self.target, self.fs = _path(spark, self.path)
        if self.fs.exists(self.target) and not (overwrite and self.fs.exists(_path(spark, f"{self.path}/{MANIFEST}")[0])):
            raise FileExistsError(path)  # a folder that isn't a bundle is never replaced
        self.stage = f"{self.path}.stage"
        self.fs.delete(_path(spark, self.stage)[0], True)
        self.told: dict[str, dict] = {}
        self.schemas: dict[str, dict] = {}

    def put(self, name: str, rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """Write a table, in folders by the columns of by, so that who asks for one value reads no other's files."""
        rows.write.partitionBy(*by).parquet(f"{self.stage}/{name}") if by else rows.write.parquet(f"{self.stage}/{name}")
        out = self.spark.read.schema(rows.schema).parquet(f"{self.stage}/{name}")
        self.schemas[name] = rows.schema.jsonValue()
        self.told[name] = fingerprint(out)
        if self.progress:
            print(json.dumps({"table": name, "rows": self.told[name]["rows"], "seconds": round(time.time() - self.began, 1)}), file=sys.stderr, flush=True)
        return out

    def csv(self, name: str, rows: DataFrame, order: list[Column]) -> None:
        export_csv(rows, f"{self.stage}/csv/{name}.csv", order)

    def commit(self, about: dict[str, Any] | None = None) -> str:
        """Write the manifest and swap the folders: until the new one is in place, the old one stays beside it. Returns the bundle id."""
        content = {"tables": self.told, "schemas": self.schemas, "about": about or {}}
        bundle_id = hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        out = self.fs.create(_path(self.spark, f"{self.stage}/{MANIFEST}")[0], True)
        out.write(json.dumps({"bundle_id": bundle_id} | content, sort_keys=True, ensure_ascii=False).encode())
        out.close()
        stage, old = _path(self.spark, self.stage)[0], _path(self.spark, f"{self.path}.old")[0]
        had = self.fs.exists(self.target)
        if had:
            self.fs.delete(old, True)
            if not self.fs.rename(self.target, old):
                raise OSError(f"{self.path} can't be moved aside")
        if not self.fs.rename(stage, self.target):
            if had:
                self.fs.rename(old, self.target)
            raise OSError(f"{self.path} can't be put in place")
        self.fs.delete(old, True)
        return bundle_id


    def discard(self) -> None:
        self.fs.delete(_path(self.spark, self.stage)[0], True)


def save(spark: SparkSession, tables: dict[str, DataFrame], path: str, overwrite: bool = False, about: dict[str, Any] | None = None) -> str:
    writer = Writer(spark, path, overwrite)
    for name, rows in sorted(tables.items()):
        writer.put(name, rows)
    return writer.commit(about)


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))


def load(spark: SparkSession, path: str, expected: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """Tables of a bundle; with verify, each must still have the rows that the manifest names."""
    told = manifest(spark, path)
    if expected and told["bundle_id"] != expected:
        raise ValueError(f"bundle {told['bundle_id']}, not {expected}")
    tables = {name: spark.read.schema(StructType.fromJson(told["schemas"][name])).parquet(f"{path}/{name}") for name in told["tables"]}
    for name, rows in tables.items() if verify else ():
        if fingerprint(rows) != told["tables"][name]:
            raise ValueError(f"table {name} isn't what was saved")
    return tables


def export_csv(rows: DataFrame, path: str, order: list[Column] = ()) -> None:
    """One CSV file in UTF-8 with byte order mark and LF, sorted on request: complex columns as JSON, booleans as true and false, null as an empty cell.

    Executors write sorted parts; the driver only copies them one after another, byte by byte.
    """
    spark = rows.sparkSession
    plain = (rows.orderBy(*order) if order else rows).select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
    plain.write.option("header", "false").option("escape", '"').option("emptyValue", '""').option("lineSep", "\n").mode("overwrite").csv(f"{path}.parts")
    parts, fs = _path(spark, f"{path}.parts")
    names = sorted(s.getPath().toString() for s in fs.listStatus(parts) if s.getPath().getName().startswith("part-"))
    out = fs.create(_path(spark, path)[0], True)
    out.write("\ufeff".encode() + (",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' for c in rows.columns) + "\n").encode())
    for name in names:
        part = fs.open(_path(spark, name)[0])
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.close()
    fs.delete(parts, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written by export_csv, or one like it: the header must name the columns of the schema, and bad cells are errors."""
    wanted = spark.createDataFrame([], schema).schema
    first = spark.read.text(path).first()
    head = next(csv.reader([first.value.removeprefix("\ufeff")]), []) if first else []
    if head != wanted.names:
        raise ValueError(f"{path}: columns {head}, not {wanted.names}")
    deep = {f.name: f.dataType for f in wanted if isinstance(f.dataType, (ArrayType, MapType, StructType))}
    flat = ", ".join(f"`{f.name}` " + ("string" if f.name in deep else f.dataType.simpleString()) for f in wanted)
    rows = spark.read.schema(flat).option("header", "true").option("mode", "FAILFAST").option("multiLine", "true").option("escape", '"').option("enforceSchema", "true").csv(path)
    return rows.withColumns({n: F.from_json(n, t, {"mode": "FAILFAST"}) for n, t in deep.items()}) if deep else rows
