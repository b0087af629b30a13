"""A store of computed series: what was asked before is read, only the rest is computed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions.base import written
from epochlens.functions.text import series_key
from epochlens.sources.segments import Segments


class SeriesStore:
    """Rows of series by the digest of the parameters that they were computed from, in segments below root.

    A request's key covers its parameters and the version of the corpus, so that a changed filter or a new corpus is a new
    series. Each call writes one segment of new rows, none if nothing is missing, and notes in another which keys it used.
    """

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.rows, self.uses, self.version = Segments(spark, f"{root}/rows"), Segments(spark, f"{root}/uses"), version

    def keyed(self, requests: DataFrame, parameters: dict[str, Column]) -> DataFrame:
        """requests with series_key; equal requests have equal keys, whatever the order of the parameters."""
        return requests.withColumn("series_key", series_key({**parameters, "corpus_version": F.lit(self.version)}))

    def fetch(self, requests: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The series of keyed requests, a row a point, with series_key.

        compute gets the requests whose key isn't stored, once each, and returns their rows with series_key; it isn't called
        where there are none. A series without rows is computed again each time.
        """
        requests = written(requests.dropDuplicates(["series_key"]), "requests")
        version, stored = self.rows.live()
        missing = requests
        if stored:
            missing = requests.join(self.rows.read(stored).select("series_key").distinct(), "series_key", "left_anti")
        if missing.limit(1).count():
            new = self.rows.write(compute(written(missing, "missing")))
            stored = [*stored, {"name": new}]
            self.rows.register(version, stored)
        used, before = self.uses.live()
        self.uses.register(used, [*before, {"name": self.uses.write(requests.select("series_key").withColumn("used", F.lit(used + 1)))}])
        return self.rows.read(stored).join(requests.select("series_key"), "series_key", "left_semi")

    def evict(self, keep: int) -> None:
        """Leave the series of the keep keys that were used last, the smaller key of equals, in one segment."""
        version, stored = self.rows.live()
        used, notes = self.uses.live()
        if not stored:
            return
        last = self.uses.read(notes).groupBy("series_key").agg(F.max("used").alias("used")).orderBy(F.desc("used"), "series_key").limit(keep)
        last = written(last, "kept")
        self.rows.register(version, [{"name": self.rows.write(self.rows.read(stored).join(last.select("series_key"), "series_key", "left_semi"))}])
        self.uses.register(used, [{"name": self.uses.write(last)}])
        self.rows.vacuum()
        self.uses.vacuum()
