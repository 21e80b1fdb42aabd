"""A table of current rows by key that batches are merged into, bucket by bucket.

Rows lie in buckets by a hash of their key. A batch reads and writes only the buckets that its
keys fall into; all other files stay as they are. What a version consists of is said by its
manifest, which is published by one rename: readers see the version before or the one after,
and a batch that failed half-way leaves files that no manifest names. Batches have numbers, and
a number that was merged already changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..storage import Files
from .merging import merge, without_repeats

BUCKET, ACTION = "__bucket", "merge_action"


class ConflictError(RuntimeError):
    """Another writer published the version that this one was about to publish."""


class Snapshots:
    """The versions of one table, in a folder.

    keep, provenance, status and invalidated are those of merging.merge. The number of buckets
    is fixed when the first version is written: aim at some hundred MB of rows each.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, content: str, buckets: int = 64,
        keep: list[str] = (), provenance: list[str] = (), status: str | None = None, invalidated: list[str] = (),
    ):
        self.spark, self.path, self.key, self.content = spark, path.rstrip("/"), key, content
        self.rules = {"keep": keep, "provenance": provenance, "status": status, "invalidated": invalidated}
        self.files = Files(spark, self.path)
        self._buckets = buckets

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, the latest unless given: version, batch, buckets, schema, and the folder of each bucket."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "batch": None, "buckets": self._buckets, "schema": None, "folders": {}}
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        return json.loads(self.files.read(f"manifests/{version or known[-1]:012}.json"))

    def _rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f for b, f in manifest["folders"].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, without what became of them."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing was merged yet")
        return self._rows(manifest).drop(ACTION)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        manifest = self.manifest()
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        wanted = self.spark.createDataFrame([(k,) for k in keys], StructType([schema[self.key]]))
        buckets = {str(r[0]) for r in wanted.select(self._bucket(manifest["buckets"])).distinct().collect()}
        return self._rows(manifest, sorted(buckets)).drop(ACTION).join(F.broadcast(wanted.distinct()), self.key, "left_semi")

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int").alias(BUCKET)

    def merge(self, batch: DataFrame, number: int) -> dict[str, int]:
        """Merges a batch and publishes the next version; how many rows were CREATED, UPDATED, UNCHANGED and KEPT.

        KEPT counts the other rows of the buckets read. A number not above the last one's is a
        repeat: nothing happens and the counts are empty. A batch with two contents of a key
        raises ValueError and leaves the table as it is. Null keys match nothing. If nothing
        changes, only the number is published.
        """
        manifest = self.manifest()
        if manifest["batch"] is not None and number <= manifest["batch"]:
            return {}
        batch = without_repeats(batch, self.key, self.content)
        schema = batch.schema
        if manifest["schema"] is not None:
            schema = StructType.fromJson(json.loads(manifest["schema"]))
            schema = StructType([f for f in schema.fields if f.name != ACTION])
            batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        bucket = self._bucket(manifest["buckets"])
        touched = sorted(str(r[0]) for r in batch.select(bucket).distinct().collect())
        old = self._rows(manifest, touched).drop(ACTION) if manifest["schema"] is not None else self.spark.createDataFrame([], schema)
        merged = merge(old, batch, self.key, self.content, **self.rules)
        # a folder of its own, so that a second try can't meet the first one's files
        folder = f"data/{manifest['version'] + 1:012}-{uuid.uuid4().hex}"
        dealt = merged.select("*", bucket).repartition(BUCKET)
        dealt.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = StructType([*merged.schema, StructField(BUCKET, IntegerType())])
        found = self.spark.read.schema(written).parquet(f"{self.path}/{folder}").groupBy(BUCKET, ACTION).agg(F.count("*").alias("n")).collect()
        counts: dict[str, int] = {}
        for r in found:
            counts[r[ACTION]] = counts.get(r[ACTION], 0) + r["n"]
        changed = {str(r[BUCKET]) for r in found if r[ACTION] in ("CREATED", "UPDATED")}
        for b in set(touched) - changed:
            self.files.delete(f"{folder}/{BUCKET}={b}")
        after = manifest | {
            "version": manifest["version"] + 1, "batch": number, "schema": merged.schema.json(),
            "folders": manifest["folders"] | {b: f"{folder}/{BUCKET}={b}" for b in sorted(changed)},
        }
        if not self.files.publish(f"manifests/{after['version']:012}.json", json.dumps(after)):
            self.files.delete(folder)
            raise ConflictError(f"version {after['version']} was published by another writer")
        return counts

    def outcomes(self) -> DataFrame:
        """Key and merge_action of the rows of the buckets that the last batch changed."""
        manifest = self.manifest()
        last = f"data/{manifest['version']:012}-"
        buckets = [b for b, f in manifest["folders"].items() if f.startswith(last)]
        return self._rows(manifest, buckets).select(self.key, ACTION)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """A handler for foreachBatch: a batch that is repeated after a failure is merged once."""

        def each(batch: DataFrame, number: int) -> None:
            self.merge(batch, number)

        return each

    def expire(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions and the files that only they name; how many folders went."""
        if keep < 1:
            raise ValueError("keep one version or more")
        known = self.versions()
        used = {f for v in known[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        for v in known[:-keep]:
            self.files.delete(f"manifests/{v:012}.json")
        newest = known[-1] if known else 0
        for name in self.files.names("data"):
            if int(name.partition("-")[0]) > newest:
                continue  # another writer may be at work there
            mine = [f"data/{name}/{b}" for b in self.files.names(f"data/{name}") if b.startswith(BUCKET)]
            gone += sum(self.files.delete(f) for f in mine if f not in used)
            if not any(f in used for f in mine):
                self.files.delete(f"data/{name}")
        return gone
