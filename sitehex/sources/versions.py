"""Publishing several tables at once: every load is a version of its own, and one pointer names those that count.

    <root>/versions/<table>/version=<id>/<by>=<key>/...      written once, never changed
    <root>/published/<number>.json                           which version each key of each table is read from

A load writes its rows where they will stay, in their final layout, and is checked there. Nothing shows until
:func:`switch` creates the next pointer, which takes over all given loads together and every other key from the pointer
before. A pointer is created, never overwritten: of two writers with the same number one fails and tries again on top of
the other. A load that failed, was refused or broke off is a folder that no pointer names; :func:`sweep` removes those.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sitehex.sources.layout import LAYOUTS, Layout, laid_out, writer
from sitehex.sources.publish import Check, CheckFailed, delete_path, failing, list_folders

POINTERS, VERSIONS = "published", "versions"


@dataclass(frozen=True)
class Load:
    """A checked version that no pointer names yet; ``keys`` are the partitions it replaces, those without rows included."""

    table: str
    version: str
    by: str | None
    keys: tuple[str, ...]
    filled: tuple[str, ...]
    rows: int


WHOLE = "all"  # the only key of a table without partitions


def _folder(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{VERSIONS}/{table}"


def stage(
    df: DataFrame, root: str, table: str, keys: Sequence[str] = (), checks: Sequence[Check] = (), layout: Layout | None = None
) -> Load:
    """Write the rows of ``keys`` as a new version and check it; a version that fails is removed."""
    spark = df.sparkSession
    layout = layout or LAYOUTS[table]
    version = uuid.uuid4().hex
    path = f"{_folder(root, table)}/version={version}"
    seen = Observation()
    chosen = df.where(F.col(layout.by).isin(list(keys))) if layout.by else df
    flags = [F.max((F.col(layout.by) == k).cast("int")).alias(f"k{i}") for i, k in enumerate(keys)] if layout.by else []
    # Observed last: the sampling pass of the range split would be counted too.
    rows = laid_out(chosen, layout).observe(seen, F.count(F.lit(1)).alias("rows"), *flags)
    writer(rows, layout).parquet(path)
    got = seen.get
    try:
        bad = failing(checks, spark.read.schema(df.schema).parquet(path))
        if bad:
            raise CheckFailed(bad)
    except BaseException:
        delete_path(spark, path)
        raise
    every = tuple(keys) if layout.by else (WHOLE,)
    filled = tuple(k for i, k in enumerate(every) if not layout.by or got[f"k{i}"])
    return Load(table, version, layout.by, every, filled, got["rows"])


def staged_table(spark: SparkSession, root: str, load: Load) -> DataFrame:
    """The rows of a load before it shows."""
    return spark.read.parquet(f"{_folder(root, load.table)}/version={load.version}")


def discard(spark: SparkSession, root: str, load: Load) -> None:
    """Give up a load that belongs to one that failed."""
    delete_path(spark, f"{_folder(root, load.table)}/version={load.version}")


def _numbers(spark: SparkSession, root: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{POINTERS}")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def pointer(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and content of the newest complete pointer: ``{table: {"by": column, "parts": {key: version}}}``."""
    for number in reversed(_numbers(spark, root)):
        text = spark.read.text(f"{root.rstrip('/')}/{POINTERS}/{number:09d}.json", wholetext=True).collect()
        try:
            return number, json.loads(text[0][0])
        except (IndexError, ValueError):
            continue  # its writer broke off
    return 0, {}


def switch(spark: SparkSession, root: str, loads: Sequence[Load], tries: int = 5) -> int:
    """Publish all ``loads`` with one new pointer and return its number."""
    hadoop = spark._jvm.org.apache.hadoop
    for _ in range(tries):
        _, tables = pointer(spark, root)
        for load in loads:
            parts = dict(tables.get(load.table, {}).get("parts", {}))
            for key in load.keys:
                parts.pop(key, None)
            parts |= dict.fromkeys(load.filled, load.version)
            tables[load.table] = {"by": load.by, "parts": parts}
        number = (_numbers(spark, root) or [0])[-1] + 1
        where = hadoop.fs.Path(f"{root.rstrip('/')}/{POINTERS}/{number:09d}.json")
        fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            out = fs.create(where, False)
        except Exception as taken:  # a Java exception: only an existing file means another writer
            if "FileAlreadyExists" not in str(taken) and "already exists" not in str(taken):
                raise
            continue
        out.write(json.dumps(tables).encode())
        out.close()
        return number
    raise RuntimeError(f"another writer took the pointer {tries} times")


def is_published(spark: SparkSession, root: str, table: str) -> bool:
    return table in pointer(spark, root)[1]


def open_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A published table. Its files never change, so a reader keeps one consistent state while others switch."""
    entry = pointer(spark, root)[1][table]
    folder = _folder(root, table)
    parts = entry["parts"]
    if not parts:  # all keys were emptied: the schema of any version
        newest = list_folders(spark, folder)[-1]
        return spark.read.parquet(f"{folder}/{newest}").where("false")
    if entry["by"] is None:
        return spark.read.parquet(f"{folder}/version={parts[WHOLE]}")
    paths = [f"{folder}/version={version}/{entry['by']}={key}" for key, version in parts.items()]
    return spark.read.option("basePath", folder).parquet(*paths).drop("version")


def sweep(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove versions that none of the newest ``keep`` pointers names. Not while a load is being staged."""
    named = set()
    for number in _numbers(spark, root)[-keep:]:
        text = spark.read.text(f"{root.rstrip('/')}/{POINTERS}/{number:09d}.json", wholetext=True).collect()
        for table, entry in json.loads(text[0][0]).items() if text else ():
            named |= {(table, version) for version in entry["parts"].values()}
    gone = []
    for table in list_folders(spark, f"{root.rstrip('/')}/{VERSIONS}"):
        for folder in list_folders(spark, _folder(root, table)):
            if (table, folder.removeprefix("version=")) not in named:
                delete_path(spark, f"{_folder(root, table)}/{folder}")
                gone.append(f"{table}/{folder}")
    return gone
