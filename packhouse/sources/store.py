"""Versioned tables: a new version is written beside the old ones and then marked committed.

A reader takes the highest committed version, so a half-written one is never seen, and no
path is overwritten while it is read. A version is one small file, its manifest: the folders its rows lie in. Tables that are
merged into lie in parts by a hash of their key, and a merge writes the parts that its batch touches; the manifest
names the other parts where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a merged table. A table of n bytes does well with n / 1 GB of them; each costs a path in the manifest.
PARTS = 64
PART = "store_part"


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text appear in one step; False if `path` is there already.

    The text is written to a hidden file first, so a crash leaves no half-written `path`. HDFS renames without
    overwriting atomically. A local file system checks for `path` just before, and an object store may copy: with
    several writers, give those a store that offers renaming without overwriting, or one writer at a time.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    target = hadoop.Path(path)
    system = target.getFileSystem(conf)
    target = system.makeQualified(target)
    draft = hadoop.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    plain = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, plain)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        system.delete(draft, False)
        return False
    return True


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in `folder`, hidden ones left out; none if there is no such folder."""
    system, target = _located(spark, folder)
    names = [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []
    return sorted(n for n in names if n[0] not in "._")


def read_text(spark: SparkSession, path: str) -> str:
    """The text of one small file."""
    system, target = _located(spark, path)
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that is not there is no error."""
    system, target = _located(spark, path)
    system.delete(target, True)


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> list[int]:
        """Numbers of the marker files, the newest first."""
        names = children(self.spark, f"{self.root}/commits")
        return sorted((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), reverse=True)

    def manifest(self, version: int) -> dict | None:
        """What a version consists of: `folders` and, if it is in parts, `key`, `n_parts`, the `part` of each folder and
        the last number `applied` of each stream. None for a marker that cannot be read: it is no commit."""
        try:
            found = json.loads(read_text(self.spark, f"{self.root}/commits/v{version}"))
            return found if found["version"] == version and isinstance(found["folders"], list) else None
        except (ValueError, KeyError, TypeError):
            return None

    def _newest(self) -> dict | None:
        return next((m for v in self.versions() if (m := self.manifest(v))), None)

    def current_version(self) -> int:
        """The newest committed version, 0 before the first."""
        newest = self._newest()
        return newest["version"] if newest else 0

    def _rows(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame | None:
        newest = self._newest()
        return self._rows(newest["folders"], newest["schema"]) if newest else None

    def _publish(self, version: int, manifest: dict) -> int:
        """Of two writers of one version the second fails and leaves the first's data alone, as far as `publish` can tell on
        the file system at hand. A marker that cannot be read blocks nothing: its number is passed over."""
        while not publish(self.spark, f"{self.root}/commits/v{version}", json.dumps({"version": version, **manifest}) + "\n"):
            if self.current_version() >= version:
                raise RuntimeError(f"version {version} was committed by another writer")
            version += 1
        return version

    def commit(self, df: DataFrame) -> int:
        """Write `df` whole as the next version. A crash before the marker leaves the old one current."""
        version = self.current_version() + 1
        path = f"data/v{version}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{path}")
        return self._publish(version, {"schema": _ddl(df), "folders": [path]})

    def merge(self, batch: DataFrame, key: str, apply: Callable[[DataFrame, DataFrame], DataFrame],
              start: DataFrame | None = None, parts: int = PARTS, once: tuple[str, int] | None = None) -> int:
        """Commit `apply(old, batch)` as the next version, writing only the parts that have keys of `batch`.

        `apply` gets the old rows of these parts alone; it must give rows of a key only for that key's old rows and batch
        rows, and keep those that the batch says nothing about. An empty store begins with the rows of `start`, and one that
        is not yet in parts by `key` is written whole, once, in `parts` parts. `batch` is read twice. A batch without rows
        commits nothing. `once` is a stream and a number: the manifest remembers each stream's largest number, and a batch
        whose number is not above it commits nothing.
        """
        newest = self._newest()
        applied = dict(newest.get("applied", {})) if newest else {}
        if once:
            stream, number = once
            if number <= applied.get(stream, number - 1):
                return newest["version"]
            applied[stream] = number
        version = newest["version"] + 1 if newest else 1
        whole = newest is None or newest.get("key") != key
        n_parts = parts if whole else newest["n_parts"]
        part = part_of(key, n_parts)
        if whole:
            old, kept = start if newest is None else self._rows(newest["folders"], newest["schema"]), {}
            if old is None:
                old = batch.limit(0)
        else:
            places = dict(zip(newest["parts"], newest["folders"]))
            touched = {r[0] for r in batch.select(part.alias(PART)).distinct().collect()}
            if not touched:
                return newest["version"]
            old = self._rows([f for p, f in places.items() if p in touched], newest["schema"])
            kept = {p: f for p, f in places.items() if p not in touched}
        merged = apply(old, batch)
        path = f"data/v{version}-{uuid.uuid4().hex}"
        merged.withColumn(PART, part).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.root}/{path}")
        written = {int(n.split("=")[1]): f"{path}/{n}" for n in children(self.spark, f"{self.root}/{path}")}
        places = kept | written
        return self._publish(version, {
            "schema": _ddl(merged), "key": key, "n_parts": n_parts, "parts": sorted(places), "applied": applied,
            "folders": [places[p] for p in sorted(places)]})

    def expire(self, keep: int = 1) -> None:
        """Delete the data that the newest `keep` committed versions do not name.

        Only while no one writes to the store or reads an older version: the data of a commit under way is not named yet.
        """
        if keep < 1:
            raise ValueError("keep at least one version")
        newest = [m for v in self.versions() if (m := self.manifest(v))][:keep]
        if not newest:
            return
        named = {f.removeprefix("data/") for m in newest for f in m["folders"]}
        used = {f.split("/")[0] for f in named}
        for name in children(self.spark, f"{self.root}/data"):
            if name not in used:
                delete(self.spark, f"{self.root}/data/{name}")
            elif name not in named:
                for part in children(self.spark, f"{self.root}/data/{name}"):
                    if f"{name}/{part}" not in named:
                        delete(self.spark, f"{self.root}/data/{name}/{part}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def part_of(key: str, n_parts: int) -> Column:
    """The part a row lies in; rows without a key share one."""
    return F.pmod(F.xxhash64(key), F.lit(n_parts)).cast("int")
