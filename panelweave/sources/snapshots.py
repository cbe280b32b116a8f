"""Snapshots whose partitions are replaced in place.

A refresh writes the partitions it brings under a folder of its own and then, last, a manifest that says for every partition
in which folder it lies. A reader takes the newest manifest: it sees all of a refresh or nothing of it, and partitions
that a refresh does not bring keep their files. A manifest appears by a rename, so none is seen half written.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The newest manifest: its number, the refreshes taken in, and the folder of each partition. Number 0 for a new snapshot."""
    folder, fs = _files(spark, f"{path}/{MANIFESTS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n))]
    if not numbers:
        return {"number": 0, "refreshes": [], "parts": {}}
    newest, _ = _files(spark, f"{path}/{MANIFESTS}/{max(numbers)}.json")
    stream = fs.open(newest)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, manifest: dict) -> None:
    final, fs = _files(spark, f"{path}/{MANIFESTS}/{manifest['number']}.json")
    draft, _ = _files(spark, f"{path}/{MANIFESTS}/.{manifest['number']}-{manifest['refreshes'][-1]}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        raise RuntimeError(f"another refresh committed manifest {manifest['number']} of {path}; run this one again")


def refresh_snapshot(df: DataFrame, path: str, partition: list[str], refresh: str) -> int:
    """Replace the partitions that ``df`` holds; gives the number of the manifest.

    ``refresh`` names this refresh. One that failed may be run again under its name, and one that was taken in does nothing. Without rows nothing
    is replaced. Files that no manifest names any more stay until ``drop_unused``.
    """
    spark = df.sparkSession
    old = manifest_of(spark, path)
    if refresh in old["refreshes"]:
        return old["number"]
    target = f"{path}/{refresh}"
    df.hint("rebalance", *[F.col(c) for c in partition]).write.mode("overwrite").partitionBy(*partition).parquet(target)
    pattern, fs = _files(spark, "/".join([target, *[f"{c}=*" for c in partition]]))
    found = [s.getPath().toString() for s in fs.globStatus(pattern)]
    names = ["/".join(p.rstrip("/").split("/")[-len(partition):]) for p in found]
    new = {"number": old["number"] + 1, "refreshes": [*old["refreshes"], refresh], "parts": old["parts"] | {n: refresh for n in names}}
    _commit(spark, path, new)
    return new["number"]


def read_refreshed(spark: SparkSession, path: str) -> DataFrame:
    """The snapshot as of its newest manifest."""
    parts = manifest_of(spark, path)["parts"]
    if not parts:
        raise ValueError(f"{path} holds no partition")
    tables = []
    for refresh in sorted(set(parts.values())):
        folder = f"{path}/{refresh}"
        own = [f"{folder}/{p}" for p, r in sorted(parts.items()) if r == refresh]
        tables.append(spark.read.option("basePath", folder).parquet(*own))
    return reduce(lambda a, b: a.unionByName(b), tables)


def drop_unused(spark: SparkSession, path: str) -> int:
    """Delete partition folders that the newest manifest does not name; run it when no reader uses an older one."""
    manifest, dropped = manifest_of(spark, path), 0
    depth = len(next(iter(manifest["parts"]), "").split("/"))
    for refresh in manifest["refreshes"]:
        pattern, fs = _files(spark, "/".join([path, refresh, *["*=*"] * depth]))
        for status in fs.globStatus(pattern) or []:
            name = "/".join(status.getPath().toString().rstrip("/").split("/")[-depth:])
            if manifest["parts"].get(name) != refresh:
                fs.delete(status.getPath(), True)
                dropped += 1
    return dropped
