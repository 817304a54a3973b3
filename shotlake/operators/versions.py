"""Tables as copy-on-write snapshots, over plain Parquet folders.

Rows lie in buckets by their key. A write makes new files for the buckets it touches, then a list of the files that
make up the new version, and last one row that names the list. Until that row is there, readers see the version before;
files of a write that failed are never read. Earlier versions stay readable.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotlake.operators.catalog import upsert


class Conflict(Exception):
    """Another writer committed the same version first."""


class Commits:
    """States (small lists of rows) under rising versions. A state counts once its commit row is written."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _all(self) -> dict[int, str]:
        """version -> state. Of two commits of one version that with the smaller name holds."""
        try:
            rows = self.spark.read.schema("version int, state string").parquet(f"{self.folder}/commits/*")
            return {r["version"]: r["state"] for r in rows.groupBy("version").agg(F.min("state").alias("state")).collect()}
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}

    def get(self, version: int | None = None) -> tuple[int, list]:
        """(version, rows) of the latest or the given version; (-1, []) before the first."""
        known = self._all()
        if version is None:
            version = max(known, default=-1)
        if version == -1:
            return -1, []
        if version not in known:
            raise ValueError(f"no version {version}")
        return version, self.spark.read.schema(self.schema).parquet(f"{self.folder}/states/{known[version]}").collect()

    def put(self, version: int, rows: list[tuple]) -> None:
        name = uuid.uuid4().hex
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/states/{name}")
        self.spark.createDataFrame([(version, name)], "version int, state string").coalesce(1).write.parquet(f"{self.folder}/commits/{version}-{name}")
        if self._all()[version] != name:
            raise Conflict(f"version {version}")


class Versioned:
    """A table of one row per key (never null), in a folder of its own. The number of buckets holds for its life and bounds what the driver lists."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.commits = Commits(spark, self.folder, "bucket int, path string, rows long, columns string")

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _files(self, rows: DataFrame) -> list[tuple]:
        """Writes rows by bucket; (bucket, path, rows, columns) of each."""
        path, columns = f"{self.folder}/data/{uuid.uuid4().hex}", rows.schema.json()
        rows.withColumn("_bucket", self._bucket()).repartition(self.buckets, "_bucket").write.partitionBy("_bucket").parquet(path)
        counts = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(path).groupBy("_bucket").count().collect()  # a row a bucket
        return [(r["_bucket"], f"{path}/_bucket={r['_bucket']}", r["count"], columns) for r in counts]

    def _read(self, state: list, only: set[int] | None = None) -> DataFrame | None:
        if not state:
            return None
        schema = T.StructType.fromJson(json.loads(state[0]["columns"]))
        paths = [r["path"] for r in state if r["path"] and (only is None or r["bucket"] in only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self) -> int:
        return self.commits.get()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The latest or an earlier version."""
        rows = self._read(self.commits.get(version)[1])
        if rows is None:
            raise ValueError("nothing has been written")
        return rows

    def write(self, changes: DataFrame | None = None, deleted: DataFrame | None = None) -> int:
        """The next version: rows of `changes` are new or overlay what is there (a null leaves the old value), keys in `deleted` go.

        Only buckets with such a key are read and rewritten. Returns the version; raises Conflict if another writer was first.
        """
        version, state = self.commits.get()
        parts = [d.select(self._bucket().alias("b")) for d in (changes, deleted) if d is not None]
        touched = {r["b"] for p in parts for r in p.distinct().collect()}
        old = self._read(state, touched)
        rows = changes if old is None else old if changes is None else upsert(old, changes, self.key)
        if rows is None:
            raise ValueError("the first version needs rows")
        if deleted is not None:
            rows = rows.join(deleted.select(self.key).distinct(), self.key, "left_anti")
        rows = rows.select(*(old.columns if old is not None else rows.columns))
        new = [(r["bucket"], r["path"], r["rows"], r["columns"]) for r in state if r["bucket"] not in touched and r["path"]] + self._files(rows)
        self.commits.put(version + 1, new or [(None, None, 0, rows.schema.json())])
        return version + 1
