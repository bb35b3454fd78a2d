"""A table in hash buckets of its key, of which an upsert reads and writes only those that it touches.

    folder/data/<commit>/bucket=<k>/...   rows of bucket k as of that commit
    folder/manifests/<number>.json        for each bucket the folder that holds it; the last number is the table

A commit writes new folders for its buckets, which nothing reads yet, and then a manifest that names them beside the old folders of
all other buckets.  A manifest is created under its final name only if there is none, by a rename; of two writers one fails and
may try again.  A task or a job that is lost leaves folders that no manifest names; ``vacuum`` deletes these.  A batch that a stream runs again is
known by its number and changes nothing.

Keys are hashed, so a bucket holds an equal share of the keys.  Rows of one key are reduced to the last of them before they are dealt, so a hot key is one row of one bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class ConcurrentCommit(Exception):
    """Another writer has taken the manifest number."""


class BucketedTable:
    """keys: columns that name a row; order: column whose highest value wins (ties: the later upsert's row)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _children(self, *parts: str) -> list[str]:
        fs, path = self._files(), self._path(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> dict:
        """The last manifest: number, schema, folder of each bucket, batches that are in it."""
        numbers = [int(n.removesuffix(".json")) for n in self._children("manifests") if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "schema": None, "buckets": {}, "batches": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{max(numbers)}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        fs, name = self._files(), f"{manifest['number']}.json"
        fs.mkdirs(self._path("manifests"))
        hidden, final = self._path("manifests", f"_{uuid.uuid4().hex}"), self._path("manifests", name)
        out = fs.create(hidden, True)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(hidden, final):
            fs.delete(hidden, False)
            raise ConcurrentCommit(f"manifest {name} is there already")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError(f"no table in {self.folder}")
        return self._read(m, buckets).drop("bucket")

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Rows of the wanted keys, from the buckets that these are in."""
        touched = self._touched(wanted.select(*self.keys).withColumn("bucket", self._bucket()))
        return self.read(touched).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def _read(self, m: dict, buckets: list[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        paths = [f"{self.folder}/data/{commit}/bucket={b}" for b, commit in m["buckets"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn("bucket", self._bucket())

    def _bucket(self):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most as many as there are buckets

    def _last(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the highest order, of equal ones the one with the higher ``__write``."""
        w = Window.partitionBy("bucket", *self.keys).orderBy(F.desc_nulls_last(self.order), F.desc("__write"))
        return rows.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> list[int]:
        """Merge rows by key; the buckets that were rewritten.  batch: (stream, number), to do nothing if it is in already."""
        m = self.manifest()
        if batch and m["batches"].get(batch[0], -1) >= batch[1]:
            return []
        commit = f"{m['number'] + 1}-{uuid.uuid4().hex}"
        # equal rows of one batch are told apart by all their columns, so that a retry picks the same
        plain = [c for c, t in rows.dtypes if not t.startswith("map")]
        fresh = rows.withColumn("bucket", self._bucket()).withColumn("__write", F.struct(F.lit(1).alias("turn"), F.to_json(F.struct(*plain)).alias("text")))
        staged = f"{self.folder}/data/{commit}/_fresh"
        self._last(fresh).write.parquet(staged)
        fresh = self.spark.read.parquet(staged)
        touched = self._touched(fresh)
        if touched:
            merged = fresh
            if m["schema"] is not None:
                old = self._read(m, touched).withColumn("__write", F.struct(F.lit(0).alias("turn"), F.lit("").alias("text")))
                merged = self._last(old.unionByName(fresh, allowMissingColumns=True))
            merged.drop("__write").repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/data/{commit}/rows")
            fs = self._files()
            for b in touched:
                fs.rename(self._path("data", commit, "rows", f"bucket={b}"), self._path("data", commit, f"bucket={b}"))
            fs.delete(self._path("data", commit, "rows"), True)
            m["schema"] = json.loads(merged.drop("__write", "bucket").schema.json())
        self._files().delete(self._path("data", commit, "_fresh"), True)
        m["number"] += 1
        m["buckets"] |= {str(b): commit for b in touched}
        if batch:
            m["batches"][batch[0]] = batch[1]
        self._publish(m)
        return touched

    def sink(self, stream: DataFrame, name: str, checkpoint: str):
        """A stream writer that upserts its batches, each once."""

        def write(batch: DataFrame, number: int) -> None:
            self.upsert(batch, (name, number))

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)

    def vacuum(self, keep: Callable[[str], bool] = lambda commit: False) -> list[str]:
        """Delete manifests but the last, and commits that it does not name and ``keep`` does not hold back; no reader or writer may be at work."""
        m, fs, gone = self.manifest(), self._files(), []
        named = set(m["buckets"].values())
        for name in self._children("manifests"):
            if name != f"{m['number']}.json":
                fs.delete(self._path("manifests", name), False)
        for commit in self._children("data"):
            if commit not in named and not keep(commit):
                fs.delete(self._path("data", commit), True)
                gone.append(commit)
            for child in self._children("data", commit):
                bucket = child.removeprefix("bucket=")
                if commit in named and m["buckets"].get(bucket) != commit and not keep(commit):
                    fs.delete(self._path("data", commit, child), True)
        return gone
