"""Several tables that change together: a reader sees all of a write or nothing of it.

A store is a folder. Each write puts its rows into parts of its own, one for
each table, and makes a list that says for each manual which part is valid. A
manifest then names the list and the parts; it is written beside and put in
place by one rename under the next number. A reader takes the manifest of the
highest number and reads what it names, so it never sees a write that is under
way or was broken off, and a manual without rows in its newest part has none,
whatever older parts hold of it. Two writers that begin at the same number
can't both take the next one: the later is told so and has changed nothing.

Parts that no manifest names any more are removed by ``swept``. A store has one
list row for each manual and write, so lists are tables too.
"""

from __future__ import annotations

import json
import time
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = 12  # digits of a manifest's number


class Conflict(RuntimeError):
    """Another write was completed since this one began."""


class Files:
    """The few operations on a store's folder that no DataFrame has."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.conf, self.root = spark._jsparkSession.sessionState().newHadoopConf(), path.rstrip("/")
        self.at = self.fs.Path(self.root).getFileSystem(self.conf)

    def listed(self, name: str) -> dict[str, int]:
        """The names in a folder of the store, each with the second it was changed."""
        path = self.fs.Path(f"{self.root}/{name}")
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.at.listStatus(path)} if self.at.exists(path) else {}

    def read(self, name: str) -> str:
        opened = self.at.open(self.fs.Path(f"{self.root}/{name}"))
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file beside its place and moves it there whole; False if there is one already."""
        folder, last = name.rsplit("/", 1)
        beside, target = (self.fs.Path(f"{self.root}/{folder}/{n}") for n in (f".{uuid.uuid4().hex}", last))
        out = self.at.create(beside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.at.exists(target) and self.at.rename(beside, target):
            return True
        self.at.delete(beside, False)
        return False

    def remove(self, name: str) -> None:
        self.at.delete(self.fs.Path(f"{self.root}/{name}"), True)


def manifest(spark: SparkSession, path: str) -> dict:
    """{number, list, parts by table} of the newest whole write; of an empty store number 0 and nothing."""
    files = Files(spark, path)
    names = [n for n in files.listed("_manifests") if n.endswith(".json") and not n.startswith(".")]
    return json.loads(files.read(f"_manifests/{max(names)}")) if names else {"number": 0, "list": None, "parts": {}}


class Write:
    """One write of several tables for some manuals: ``with Write(..) as w: w.add("vectors", rows)``. It is completed when the block ends without an error; after one its parts are removed.

    manuals: (manual_id) whose rows this write replaces, also those for which it has none.
    """

    def __init__(self, spark: SparkSession, path: str, manuals: DataFrame):
        self.spark, self.path, self.manuals = spark, path.rstrip("/"), manuals.select("manual_id").distinct()
        self.part = uuid.uuid4().hex
        self.begun = manifest(spark, path)
        self.tables: list[str] = []

    def add(self, table: str, rows: DataFrame, kind: str = "parquet") -> None:
        """Writes a table's rows, those of a manual beside each other: in few files however many manuals there are, and in several for a large one."""
        self.tables.append(table)
        together = rows.hint("rebalance", "manual_id").sortWithinPartitions("manual_id")
        together.write.format(kind).save(f"{self.path}/{table}/part={self.part}")

    def own(self, table: str, schema: str, kind: str = "parquet") -> DataFrame:
        """The rows of a table that this write has added."""
        return self.spark.read.schema(schema).format(kind).load(f"{self.path}/{table}/part={self.part}")

    def complete(self) -> None:
        now = self.manuals.select("manual_id", F.lit(self.part).alias("part"))
        if self.begun["list"]:
            now = now.union(_valid(self.spark, self.path, self.begun["list"]).join(self.manuals, "manual_id", "left_anti"))
        listed = f"_lists/{self.part}"
        now.write.parquet(f"{self.path}/{listed}")
        still = {r[0] for r in _valid(self.spark, self.path, listed).select("part").distinct().collect()}  # one for each write that is still in use
        parts = {t: [p for p in [*self.begun["parts"].get(t, []), *([self.part] if t in self.tables else [])] if p in still] for t in {*self.begun["parts"], *self.tables}}
        number = self.begun["number"] + 1
        if not Files(self.spark, self.path).put(f"_manifests/{number:0{NUMBER}}.json", json.dumps({"number": number, "list": listed, "parts": parts})):
            raise Conflict(f"write {number} was completed by another writer")

    def undo(self) -> None:
        files = Files(self.spark, self.path)
        for t in self.tables:
            files.remove(f"{t}/part={self.part}")
        files.remove(f"_lists/{self.part}")

    def __enter__(self) -> Write:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        try:
            if kind is None:
                self.complete()
        except BaseException:
            self.undo()
            raise
        if kind is not None:
            self.undo()


def _valid(spark: SparkSession, path: str, listed: str) -> DataFrame:
    return spark.read.schema("manual_id string, part string").parquet(f"{path.rstrip('/')}/{listed}")


def manuals(spark: SparkSession, path: str) -> DataFrame:
    """(manual_id) of all that was written, also without rows."""
    now = manifest(spark, path)
    return _valid(spark, path, now["list"]).select("manual_id") if now["list"] else spark.createDataFrame([], "manual_id string")


def read(spark: SparkSession, path: str, table: str, schema: str, kind: str = "parquet", now: dict | None = None) -> DataFrame:
    """A table's valid rows. schema: with manual_id. now: a manifest, so that several tables are read as of the same write."""
    now = now or manifest(spark, path)
    root = f"{path.rstrip('/')}/{table}"
    parts = now["parts"].get(table, [])
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, part string").format(kind).option("basePath", root).load([f"{root}/part={p}" for p in parts])
    return rows.join(_valid(spark, path, now["list"]), ["manual_id", "part"], "left_semi").drop("part")


def swept(spark: SparkSession, path: str, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
    """Removes what none of the newest ``keep`` manifests names and what is older than so many seconds, and returns its names.

    The age protects writes that are under way; those manifests that stay
    protect readers that began before.
    """
    files, gone = Files(spark, path), []
    names = sorted(n for n in files.listed("_manifests") if n.endswith(".json") and not n.startswith("."))
    used = [json.loads(files.read(f"_manifests/{n}")) for n in names[-keep:]]
    named = {m["list"] for m in used} | {f"{t}/part={p}" for m in used for t, ps in m["parts"].items() for p in ps} | {f"_manifests/{n}" for n in names[-keep:]}
    for folder in files.listed(""):
        for name, changed in files.listed(folder).items():
            if f"{folder}/{name}" not in named and changed <= time.time() - older_than and (folder.startswith("_") or name.startswith("part=")):
                files.remove(f"{folder}/{name}")
                gone.append(f"{folder}/{name}")
    return gone
