"""Numbered commits, and what the service writes with them: S10 outbox, S11 snapshot.

A commit is a small file that appears whole (written aside, then renamed) and is
never changed.  Data is written first, under a name that no reader looks at, so a
writer that dies leaves nothing readable, and a batch that was committed is never
written again.  All calls go through the Hadoop file system of the path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockcast.operators.responses import latest_per_key


class Files:
    """The few file calls that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if it doesn't exist."""
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def move(self, source: str, target: str) -> bool:
        """False if the target exists or the rename didn't happen."""
        if self.exists(target):
            return False
        self._fs.mkdirs(self._path(target).getParent())
        return self._fs.rename(self._path(source), self._path(target))

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read(self, name: str) -> str:
        size = self._fs.getFileStatus(self._path(name)).getLen()
        data = self._fs.open(self._path(name))
        try:
            return bytes(data.readNBytes(size)).decode()
        finally:
            data.close()


class Commits:
    """Commits by ascending number in the folder ``name`` of ``files``."""

    def __init__(self, files: Files, name: str):
        self.files, self.name = files, name

    def numbers(self) -> list[int]:
        return [int(n) for n in self.files.names(self.name) if n.isdigit()]

    def get(self, number: int) -> dict:
        return json.loads(self.files.read(f"{self.name}/{number:012d}"))

    def put(self, number: int, content: dict) -> bool:
        """False if the number was committed before; its content stays."""
        aside = f"{self.name}/.{number:012d}-{uuid.uuid4().hex}"
        self.files.write(aside, json.dumps(content))
        done = self.files.move(aside, f"{self.name}/{number:012d}")
        if not done:
            self.files.delete(aside)
        return done

    def forget(self, number: int) -> None:
        self.files.delete(f"{self.name}/{number:012d}")


class Outbox:
    """The answers of each batch, visible whole or not at all.

    A batch is staged in a hidden folder, moved to ``batch_id=<n>`` and then
    committed.  Readers take the folders of committed batches.  What an earlier
    attempt left under the batch's name without a commit is replaced.
    """

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format = spark, path.rstrip("/"), format
        self.files = Files(spark, path)
        self.commits = Commits(self.files, "_commits")

    def folder(self, batch: int) -> str:
        return f"{self.path}/batch_id={batch}"

    def committed(self, batch: int) -> bool:
        return batch in self.commits.numbers()

    def stage(self, answers: DataFrame, batch: int) -> str:
        """Write the batch aside; nothing of it can be read yet."""
        name = f"_staged/{batch}-{uuid.uuid4().hex}"
        answers.write.format(self.format).save(f"{self.path}/{name}")
        return name

    def commit(self, staged: str, batch: int, about: dict | None = None) -> bool:
        """Make a staged batch readable; False if the batch was committed before."""
        if self.committed(batch):
            self.files.delete(staged)
            return False
        self.files.delete(f"batch_id={batch}")
        if not self.files.move(staged, f"batch_id={batch}"):
            raise OSError(f"could not move {staged} of {self.path}")
        return self.commits.put(batch, about or {})

    def write(self, answers: DataFrame, batch: int, about: dict | None = None) -> bool:
        return not self.committed(batch) and self.commit(self.stage(answers, batch), batch, about)

    def read(self, schema=None) -> DataFrame:
        """All committed batches with their ``batch_id``; ``schema`` is needed for an
        empty outbox."""
        folders = [self.folder(n) for n in self.commits.numbers()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", self.path)
        return (reader.schema(schema) if schema is not None else reader).format(self.format).load(folders)

    def vacuum(self) -> None:
        """Remove what writers that died have staged; not while one is at work."""
        self.files.delete("_staged")


class DeltaLog:
    """Rows by key, as a base in buckets and a delta a batch, both merged by ``merged``.

    A batch writes its own merged rows, nothing else.  After ``compact_every`` deltas,
    the buckets that they touch are merged with them and written anew; the commit of
    the new base names the folder of each bucket, so untouched buckets stay where they
    are.  What the base before the newest one needs is kept, so a reader that began
    before a compaction ends well.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 16, compact_every: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.buckets, self.compact_every = key, buckets, compact_every
        self.files = Files(spark, path)
        self.deltas, self.bases = Commits(self.files, "_deltas"), Commits(self.files, "_bases")

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row per key; must give the same however rows were merged before."""
        raise NotImplementedError

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Fold a batch in; False if it was before.  Batches may come in any order,
        but none at or below the newest base."""
        base = self.bases.numbers()
        if batch in self.deltas.numbers() or (base and batch <= base[-1]):
            return False
        name = f"delta/v={batch}-{uuid.uuid4().hex}"
        self.merged(rows).withColumn("_bucket", self._bucket()).write.parquet(f"{self.path}/{name}")
        done = self.deltas.put(batch, {"folder": name})
        if done and len(self._fresh()) >= self.compact_every:
            self.compact()
        return done

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def _fresh(self) -> list[int]:
        """Deltas that the newest base doesn't hold."""
        base = self.bases.numbers()
        return [n for n in self.deltas.numbers() if not base or n > base[-1]]

    def _base(self) -> dict[str, str]:
        """Bucket -> folder of the newest base."""
        base = self.bases.numbers()
        return self.bases.get(base[-1])["buckets"] if base else {}

    def _load(self, folders: list[str]) -> DataFrame | None:
        parts = [self.spark.read.parquet(f"{self.path}/{f}") for f in folders]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame | None:
        """One row per key; None before the first batch."""
        rows = self._load([*self._base().values(), *(self.deltas.get(n)["folder"] for n in self._fresh())])
        return None if rows is None else self.merged(rows.drop("_bucket"))

    def compact(self) -> None:
        """Merge the fresh deltas into a new base."""
        fresh = self._fresh()
        if not fresh:
            return
        deltas = self._load([self.deltas.get(n)["folder"] for n in fresh])
        old = self._base()
        touched = [str(r[0]) for r in deltas.select("_bucket").distinct().collect()]  # of a fixed number
        rows = self._load([old[b] for b in touched if b in old])
        rows = deltas if rows is None else deltas.unionByName(rows, allowMissingColumns=True)
        merged = self.merged(rows.drop("_bucket")).withColumn("_bucket", self._bucket())
        name = f"base/v={fresh[-1]}-{uuid.uuid4().hex}"
        # the bucket stays a column too, so that every folder reads alike
        merged.withColumn("b", F.col("_bucket")).repartition("b").write.partitionBy("b").parquet(f"{self.path}/{name}")
        if self.bases.put(fresh[-1], {"buckets": old | {b: f"{name}/b={b}" for b in touched}}):
            self._prune()

    def _prune(self) -> None:
        """Delete what neither the newest base nor the one before it reads."""
        bases = self.bases.numbers()
        if len(bases) < 2:
            return
        before = bases[-2]
        used = {f.split("/")[1] for n in bases[-2:] for f in self.bases.get(n)["buckets"].values()}
        for n in self.deltas.numbers():
            if n <= before:
                folder = self.deltas.get(n)["folder"]
                self.deltas.forget(n)  # first, so that no commit names a missing folder
                self.files.delete(folder)
        for n in bases[:-2]:
            self.bases.forget(n)
        for name in self.files.names("base"):
            if name not in used:
                self.files.delete(f"base/{name}")


class SnapshotLog(DeltaLog):
    """The last row of each key by ``order``."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], **kw):
        super().__init__(spark, path, key, **kw)
        self.order = order

    def merged(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.key, self.order)


class SumLog(DeltaLog):
    """Sums by key; keys whose sums are all zero are none."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], sums: list[str], **kw):
        super().__init__(spark, path, key, **kw)
        self.sums = sums

    def merged(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*self.key).agg(*[F.sum(c).alias(c) for c in self.sums])
        return out.where(" OR ".join(f"`{c}` <> 0" for c in self.sums))
