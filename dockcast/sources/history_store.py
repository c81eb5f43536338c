"""The history store with its upkeep.

Readings are appended in folders, each partitioned by city and day.  A manifest, one
commit a change, names the folders that hold now.  Whenever ``fan`` folders of one
size class have come together they are merged to one of the next class, so after n
appends a reader opens at most ``fan`` folders for each power of ``fan`` up to n, and
a reading is rewritten once a class.  Expired days leave the manifest's span at once;
their files go with the next merge or ``sweep``.  What the manifest before the newest
one names is kept, so that a reader which began before a change ends well.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.functions import ntz_literal
from dockcast.schemas import HISTORY
from dockcast.sources.history import write_history
from dockcast.streaming.commits import Commits, Files


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str, fan: int = 8, fanout: int = 16):
        self.spark, self.path, self.fan, self.fanout = spark, path.rstrip("/"), fan, fanout
        self.files = Files(spark, path)
        self.commits = Commits(self.files, "_manifests")

    def manifest(self) -> dict:
        """Folders with their class, the first day that is kept, and the newest batch."""
        known = self.commits.numbers()
        return self.commits.get(known[-1]) if known else {"folders": [], "keep_from": None, "batch": None}

    def _commit(self, manifest: dict) -> None:
        number = (self.commits.numbers() or [0])[-1] + 1
        if not self.commits.put(number, manifest):
            raise RuntimeError(f"another writer has changed {self.path}")

    def _write(self, rows: DataFrame) -> str:
        name = f"part=p{uuid.uuid4().hex}"
        write_history(rows, f"{self.path}/{name}", mode="error", fanout=self.fanout)
        return name

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch of readings; False if it, or a later one, was added before."""
        now = self.manifest()
        if now["batch"] is not None and batch <= now["batch"]:
            return False
        self._commit(now | {"folders": [*now["folders"], {"name": self._write(rows), "size": 0}], "batch": batch})
        self._merge()
        return True

    def expire(self, before: dt.date) -> None:
        """Days before ``before`` are no part of the history any more."""
        now = self.manifest()
        if now["keep_from"] is None or now["keep_from"] < before.isoformat():
            self._commit(now | {"keep_from": before.isoformat()})

    def _merge(self) -> None:
        while True:
            now = self.manifest()
            sizes = sorted({f["size"] for f in now["folders"]})
            due = next((s for s in sizes if sum(f["size"] == s for f in now["folders"]) >= self.fan), None)
            if due is None:
                break
            mine = [f["name"] for f in now["folders"] if f["size"] == due]
            name = self._write(self._load(mine, now["keep_from"]))
            rest = [f for f in now["folders"] if f["size"] != due]
            self._commit(now | {"folders": [*rest, {"name": name, "size": due + 1}]})
        self.sweep()

    def sweep(self) -> None:
        """Delete the folders and the expired days that neither the newest manifest nor
        the one before it reads."""
        known = self.commits.numbers()
        kept = [self.commits.get(n) for n in known[-2:]]
        for n in known[:-2]:
            self.commits.forget(n)
        used = {f["name"] for m in kept for f in m["folders"]}
        first = kept[0]["keep_from"] if len(kept) == 2 else None
        for name in self.files.names(""):
            if name.startswith("part=") and name not in used:
                self.files.delete(name)
            elif name.startswith("part=") and first:
                for city in self.files.names(name):
                    for day in self.files.names(f"{name}/{city}") if city.startswith("city=") else []:
                        if day.startswith("day=") and day.removeprefix("day=") < first:
                            self.files.delete(f"{name}/{city}/{day}")

    def _load(self, names: list[str], keep_from: str | None) -> DataFrame:
        typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in HISTORY.fields)
        if not names:
            return self.spark.createDataFrame([], f"{typed}, day date")
        reader = self.spark.read.schema(f"{typed}, part string, day date").option("basePath", self.path)
        df = reader.parquet(*[f"{self.path}/{n}" for n in names]).drop("part")
        return df.where(F.col("day") >= F.lit(keep_from).cast("date")) if keep_from else df

    def read(self, since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
        """Readings after ``since`` up to ``until``; day folders outside are not opened."""
        now = self.manifest()
        df = self._load([f["name"] for f in now["folders"]], now["keep_from"])
        if since is not None:
            df = df.where((F.col("day") >= F.lit(since.date())) & (F.col("ts") > ntz_literal(since)))
        if until is not None:
            df = df.where((F.col("day") <= F.lit(until.date())) & (F.col("ts") <= ntz_literal(until)))
        return df.select(*[f.name for f in HISTORY.fields])
