"""Library, expectancy and backtest results as tables."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIBRARY_SCHEMA = "pattern_id string, complexity int, frequency long, prototype array<double>"
EXPECTANCY_SCHEMA = "pattern_id string, expectancy double, win_rate double, direction string, optimal_holding int, rating string"
CONFIG_SCHEMA = "name string, value string"
RESULTS_SCHEMA = "pattern_id string, market string, strategy string, holding long, sample_size long, expectancy double"
SCHEMAS = {"library": LIBRARY_SCHEMA, "expectancy": EXPECTANCY_SCHEMA, "config": CONFIG_SCHEMA}
KEYS = {"library": "pattern_id", "expectancy": "pattern_id", "config": "name"}
#: Parts of a table by its key; an upsert writes only those it changes.
PARTS = 16


def write_library(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").json(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIBRARY_SCHEMA).json(path)


def save_state(tables: dict[str, DataFrame], folder: str) -> int:
    """Replaces whole tables, all at once, and gives the new version; tables not given stay.

    Each table is written in ``PARTS`` parts by its key to a folder that no version names yet; then one file, which names the folder of every part of
    every table, becomes the next version. A job that dies before that leaves the last version whole.
    """
    spark = next(iter(tables.values())).sparkSession
    return _commit(spark, folder, lambda last: last | {name: _write(df, folder, name) for name, df in tables.items()})


def upsert_state(spark: SparkSession, changes: dict[str, DataFrame], folder: str, tries: int = 5) -> int:
    """Puts rows in place of those with their key, in all tables at once, and gives the new version; only parts with a changed key are written anew.

    If another writer was first, the rows are put into its version instead, up to ``tries`` times. Of several changed rows with one key all are kept.
    """

    def change(last: dict) -> dict:
        out = dict(last)
        for name, df in changes.items():
            parts = {str(r[0]) for r in df.select(_part(name)).distinct().collect()}
            old = _read(spark, name, {p: path for p, path in last.get(name, {}).items() if p in parts})
            merged = old.join(df, KEYS[name], "left_anti").unionByName(df.select(*old.columns))
            out[name] = last.get(name, {}) | _write(merged, folder, name)
        return out

    for _ in range(tries - 1):
        try:
            return _commit(spark, folder, change)
        except Conflict:
            continue
    return _commit(spark, folder, change)


def load_state(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of the newest version, or of an earlier one; a missing one is empty."""
    last = _manifest(spark, folder, newest_version(spark, folder) if version is None else version)
    return {name: _read(spark, name, last.get(name, {})) for name in SCHEMAS}


class Conflict(Exception):
    """Another writer made the version that this one was about to make."""


def newest_version(spark: SparkSession, folder: str) -> int:
    """0 where nothing was saved yet."""
    path, fs = _path(spark, f"{folder}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max([0, *(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())])


def _part(name: str):
    return F.pmod(F.xxhash64(KEYS[name]), F.lit(PARTS)).cast("int").alias("part")


def _write(df: DataFrame, folder: str, name: str) -> dict[str, str]:
    """Part -> folder, of the parts that have rows."""
    path = f"{folder}/data/{name}-{uuid.uuid4().hex}"
    columns = [f.name for f in _empty(df.sparkSession, name).schema]
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in _empty(df.sparkSession, name).schema if f.name not in df.columns]
    df.select("*", *absent).select(*columns, _part(name)).repartition("part").write.partitionBy("part").parquet(path)
    home, fs = _path(df.sparkSession, path)
    found = [f.getPath().getName() for f in fs.listStatus(home)]
    return {n.removeprefix("part="): f"{path}/{n}" for n in found if n.startswith("part=")}


def _empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def _read(spark: SparkSession, name: str, parts: dict[str, str]) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(*parts.values()) if parts else _empty(spark, name)


def _path(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, folder: str, version: int) -> dict[str, dict[str, str]]:
    return json.loads(spark.read.text(f"{folder}/versions/v{version}", wholetext=True).first()[0]) if version else {}


def _commit(spark: SparkSession, folder: str, change) -> int:
    """Makes the version after the newest one from its parts. The file gets its name by a rename that fails where the name is taken."""
    version = newest_version(spark, folder) + 1
    text = json.dumps(change(_manifest(spark, folder, version - 1)), sort_keys=True)
    target, fs = _path(spark, f"{folder}/versions/v{version}")
    own, _ = _path(spark, f"{folder}/versions/.{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.getUri().getScheme() == "file":  # here a rename would replace; a link doesn't
        try:
            os.link(own.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            raise Conflict(f"version {version} of {folder}") from None
        finally:
            fs.delete(own, False)
    elif fs.exists(target) or not fs.rename(own, target):
        fs.delete(own, False)
        raise Conflict(f"version {version} of {folder}")
    return version


def config_table(spark: SparkSession, config: dict) -> DataFrame:
    """Settings as (name, value), each value as JSON."""
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in sorted(config.items())], CONFIG_SCHEMA)


def config_of(table: DataFrame) -> dict:
    return {r["name"]: json.loads(r["value"]) for r in table.collect()}


def write_backtest(results: DataFrame, folder: str, run: str) -> None:
    """Adds a run; earlier runs stay."""
    results.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").parquet(folder)


def read_latest_backtest(spark: SparkSession, folder: str, schema: str = RESULTS_SCHEMA) -> DataFrame:
    """The newest run; no rows of ``schema`` if the folder doesn't exist."""
    try:
        runs = spark.read.parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    newest = runs.agg(F.max("run_ts")).first()[0]
    return runs.where(F.col("run_ts") == newest).drop("run_ts")
