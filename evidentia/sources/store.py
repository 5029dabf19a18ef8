"""Tables kept in versions: every reader sees one whole version, whatever is being written.

A version is a manifest, a small JSON file ``versions/00000007.json`` that says where each table's files are. Files are
written first, to a folder of their own; the manifest is written aside and renamed, and a rename that finds the name
taken fails. So a version is there with all its tables or not at all, a writer that dies leaves files that no manifest
names, and of two writers that start from one version the second is refused. Tables that a new version doesn't bring
are those of the version before, so one publication may replace a table and leave its neighbours.

Defined results: a store without a version has no tables; a table without rows keeps its schema; files of an older
version stay readable until ``prune``.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another writer has published the version first."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary folder, but only on one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("executors share no local folder: set spark.checkpoint.dir to one that they all reach")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="evidentia-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; rows stay in their partitions, in their order."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """The name of a new folder in the shared place."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    """The few calls to the file system that Spark's readers and writers don't have."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        at = self.path(name)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Writes a file under a name that is free, whole at once; False if the name is taken."""
        aside = self.path(f"_aside/{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(self.path(name).getParent())
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(aside, self.path(name), plain)
        except Exception as e:  # Py4J wraps the file system's own classes
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(aside, False)
            return False
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Store:
    """Versions of tables under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder, Files(spark, folder)

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("versions") if n.endswith(".json")]

    def latest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{table: {path, schema, format}} of a version, the latest one by default; {} before the first."""
        version = self.latest() if version is None else version
        return json.loads(self.files.read(f"versions/{version:08d}.json")) if version else {}

    def publish(self, tables: dict[str, DataFrame], partition: dict[str, list[str]] | None = None, order: dict[str, list[str]] | None = None, form: str = "parquet", expect: int | None = None) -> int:
        """Writes tables and makes them a version; returns its number.

        ``partition`` names columns by whose values a table's files are kept apart, ``order`` columns that its rows are
        sorted by. ``expect`` is the version that the tables were derived from, the latest by default: if another
        writer has published since, ``Conflict`` is raised and nothing changes.
        """
        base = self.latest() if expect is None else expect
        manifest, place = dict(self.manifest(base)), f"data/{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                by, sort = (partition or {}).get(name), (order or {}).get(name)
                if sort and not by:
                    df = df.repartitionByRange(*sort)
                elif by:
                    df = df.repartition(*by)
                df = df.sortWithinPartitions(*(by or []), *sort) if sort else df
                writer = df.write.partitionBy(*by) if by else df.write
                writer.format(form).option("ignoreNullFields", "false").save(f"{self.folder}/{place}/{name}")
                manifest[name] = {"path": f"{place}/{name}", "schema": df.schema.json(), "format": form}
            if not self.files.write_new(f"versions/{base + 1:08d}.json", json.dumps(manifest, indent=1)):
                raise Conflict(f"version {base + 1} of {self.folder} is another writer's")
        except BaseException:
            self.files.remove(place)
            raise
        return base + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version. What is returned goes on reading that version, whatever is published later."""
        entry = self.manifest(version)[name]
        reader = self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).format(entry["format"])
        return reader.load(f"{self.folder}/{entry['path']}")

    def prune(self, keep: int = 1) -> None:
        """Removes all but the last versions, and data that none of those names. Not while another writer is at work."""
        versions = sorted(self.versions())
        for v in versions[:-keep]:
            self.files.remove(f"versions/{v:08d}.json")
        used = {e["path"] for v in versions[-keep:] for e in self.manifest(v).values()}
        for place in self.files.names("data"):
            tables = [f"data/{place}/{name}" for name in self.files.names(f"data/{place}")]
            for path in tables if used & set(tables) else [f"data/{place}"]:
                if path not in used:
                    self.files.remove(path)


def state_of(spark: SparkSession, path: str) -> str:
    """What tells one state of an input from another: names, lengths and times of its files."""
    files = Files(spark, path)
    listed = files.fs.listFiles(files.path(""), True) if files.fs.exists(files.path("")) else None
    found = []
    while listed is not None and listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))
