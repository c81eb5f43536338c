"""A store of model versions.

A retrained model is a new version in a folder of its own; a commit makes it the
city's current one.  No version is ever overwritten, so a service that scores with
the version before goes on, and takes the new one up between two batches.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from dockcast.operators.trees import TreePredictor
from dockcast.plans.training import load_model
from dockcast.streaming.commits import Commits, Files


class ModelStore:
    """Versions 1, 2, ... of each city's model below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = Files(spark, path)

    def _commits(self, city: str) -> Commits:
        return Commits(self.files, f"{city.lower()}/_versions")

    def publish(self, city: str, model: PipelineModel) -> int:
        """Save ``model`` as the city's next version; its number.  Of two trainers
        that end at once each gets a version."""
        folder = f"{city.lower()}/{uuid.uuid4().hex}"
        model.write().save(f"{self.path}/{folder}")
        number = (self.versions(city) or [0])[-1] + 1
        while not self._commits(city).put(number, {"folder": folder}):
            number += 1
        return number

    def versions(self, city: str) -> list[int]:
        return self._commits(city).numbers()

    def path_of(self, city: str, version: int | None = None) -> str:
        """Folder of a version, the current one by default."""
        known = self.versions(city)
        if not known or version not in (None, *known):
            raise FileNotFoundError(f"no model of {city} in {self.path}" + (f", version {version}" if version else ""))
        return f"{self.path}/{self._commits(city).get(version or known[-1])['folder']}"

    def load(self, city: str, version: int | None = None) -> PipelineModel:
        return load_model(self.path_of(city, version))

    def prune(self, city: str, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions; a service must be at one of those."""
        commits = self._commits(city)
        for old in commits.numbers()[: -max(keep, 1)]:
            folder = commits.get(old)["folder"]
            commits.forget(old)
            self.files.delete(folder)


class CurrentModels:
    """The predictor of a service: the current version of each city, as expressions,
    read again when a commit has changed it."""

    def __init__(self, store: ModelStore, cities: list[str]):
        self.store, self.cities = store, cities
        self.versions: dict[str, int] = {}
        self.predictor: TreePredictor | None = None
        self.refresh()

    def refresh(self) -> dict[str, int]:
        """Take up what was committed; the versions that score from now on."""
        now = {}
        for city in self.cities:
            known = self.store.versions(city)
            if not known:
                raise FileNotFoundError(f"no model of {city} in {self.store.path}")
            now[city] = known[-1]
        if now != self.versions:
            self.predictor = TreePredictor.load(self.store.spark, {c: self.store.path_of(c, v) for c, v in now.items()})
            self.versions = now
        return now
