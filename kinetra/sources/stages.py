"""Stage tables that are built once: a manifest says by which parameters and from which inputs, and is written last.

A stage whose manifest fits is read; one without, with another fingerprint, or whose table is not what the manifest says is built anew. All goes
through Spark's own readers and writers, so the folder can be in any store.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, fingerprint string, n_rows long, columns string"


def files_of(*tables: DataFrame) -> str:
    """A digest of the files that tables are read from: paths, sizes and times, however many there are."""
    parts = []
    for table in tables:
        files = table.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        row = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
        parts.append([row[0], str(row[1])])
    return sha256(json.dumps(parts).encode()).hexdigest()


def fingerprint(name: str, parameters: dict, inputs: str, before: str = "") -> str:
    """Of a stage: its name and parameters in order of their names, its input files and the stage before it."""
    return sha256(json.dumps([name, parameters, inputs, before], sort_keys=True, default=str).encode()).hexdigest()


class Stages:
    """A chain of stages in ``folder``; ``built`` names those that were not there."""

    def __init__(self, spark: SparkSession, folder: str, inputs: str) -> None:
        self.spark, self.folder, self.inputs = spark, folder.rstrip("/"), inputs
        self.before, self.built = "", []

    def _manifest(self, name: str) -> dict | None:
        try:
            found = self.spark.read.schema(MANIFEST).json(f"{self.folder}/{name}.manifest").collect()
        except AnalysisException:  # there is none
            return None
        return found[0].asDict() if len(found) == 1 else None

    def _there(self, name: str, mark: str) -> DataFrame | None:
        """The stage's table if its manifest is this one and it has the rows and columns that it should."""
        said = self._manifest(name)
        if not said or said["fingerprint"] != mark:
            return None
        try:
            table = self.spark.read.parquet(f"{self.folder}/{name}.{mark[:16]}")
        except AnalysisException:
            return None
        return table if table.count() == said["n_rows"] and ",".join(table.columns) == said["columns"] else None

    def run(self, name: str, build: Callable[[], DataFrame], needs: tuple[str, ...] = (), **parameters: object) -> DataFrame:
        """The stage's table; ``build`` is called only if it has to be. It has to have the columns ``needs``."""
        mark = fingerprint(name, parameters, self.inputs, self.before)
        self.before = mark
        found = self._there(name, mark)
        if found is not None:
            return found
        made = build()
        if missing := set(needs) - set(made.columns):
            raise ValueError(f"stage {name} lacks {', '.join(sorted(missing))}")
        path = f"{self.folder}/{name}.{mark[:16]}"
        made.write.mode("overwrite").parquet(path)
        table = self.spark.read.parquet(path)
        said = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(mark).alias("fingerprint"), F.lit(table.count()).alias("n_rows"), F.lit(",".join(table.columns)).alias("columns"))
        said.coalesce(1).write.mode("overwrite").json(f"{self.folder}/{name}.manifest")
        self.built.append(name)
        return table
