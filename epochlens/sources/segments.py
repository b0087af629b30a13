"""Tables that are kept as segments with a registry of versions: appended, merged and replaced without a reader noticing."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochlens.functions.base import exists


class Segments:
    """Named tables below root/segments, of which the last version in root/registry says which count.

    A version is written once: of two writers that make the same one, the second fails and changes nothing. What no
    version names, left by a writer that was lost, is never read, and vacuum() deletes it.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def live(self) -> tuple[int, list[dict]]:
        """The last version and its segments, each with its name and whatever else was registered."""
        path = f"{self.root}/registry"
        last = self.spark.read.text(path).orderBy(F.desc("version")).first() if exists(self.spark, path) else None
        return (last["version"], json.loads(last["value"])) if last else (0, [])

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> str:
        """df as a segment that doesn't count yet; its name."""
        name = uuid.uuid4().hex
        df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(f"{self.root}/segments/segment={name}")
        return name

    def register(self, after: int, segments: list[dict]) -> None:
        """Make segments the version that follows after."""
        self.spark.createDataFrame([(json.dumps(segments),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{self.root}/registry/version={after + 1}")

    def read(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/segments").parquet(*[f"{self.root}/segments/segment={s['name']}" for s in segments]).drop("segment")

    def vacuum(self) -> None:
        """Delete the segments that the last version doesn't name. Readers of earlier versions must be done."""
        keep = {f"segment={s['name']}" for s in self.live()[1]}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(path) if fs.exists(path) else []:
            if f.getPath().getName() not in keep:
                fs.delete(f.getPath(), True)
