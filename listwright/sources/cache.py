"""A cache of answers (of models, of people), kept from run to run.

Entries are (kind, key, cached_at, answer).  A key holds a hash of what was asked about, so an answer to other content
doesn't count.  Entries older than a number of days go.  Of several entries of a key, the newest counts.

A Store keeps entries in buckets of their keys' hashes.  A manifest of each version names the folder of each bucket and
its oldest entry, so a save reads and writes only buckets with new, newer or expired entries; where nothing
changes, nothing is written.  A new manifest is created only if no one has created that version; a save that comes second reads
the other's version and merges again.  A manifest that was cut off doesn't count, and folders that no manifest names are never read.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "kind string, key string, cached_at timestamp, answer string"
DAYS, BUCKETS, TRIES = 30, 64, 5
_ASKED = 300  # characters of a text that a key depends on


def _hash16(*parts: str | Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256), 1, 16)


def enrichment_key() -> Column:
    """Of what a listing says."""
    return F.concat(F.col("source_id"), F.lit(":"), _hash16("title", F.substring("description", 1, _ASKED), "category"))


def verdict_key() -> Column:
    """Of a listing's title."""
    return F.concat(F.col("source_id"), F.lit(":"), _hash16("title"))


def guide_key() -> Column:
    """Of a guide's name, city and category."""
    return F.concat(F.lit("guide:"), F.col("guide_id"), F.lit(":"), _hash16("name", "city", "category"))


def live(entries: DataFrame, now: datetime, days: int = DAYS) -> DataFrame:
    """Entries that aren't older than some days; ones without a time are."""
    return entries.filter(F.col("cached_at") >= F.lit(now - timedelta(days=days)))


def newest(*caches: DataFrame) -> DataFrame:
    """One entry for each kind and key: the newest; of equally new ones that of the first cache."""
    rows = None
    for i, c in enumerate(caches):
        one = c.select("kind", "key", "cached_at", "answer", F.lit(-i).alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    best = F.max_by(F.struct("cached_at", "answer"), F.struct("cached_at", "place", "answer"))
    return rows.groupBy("kind", "key").agg(best.alias("e")).select("kind", "key", "e.*")


def unanswered(asked: DataFrame, entries: DataFrame, kind: str, key: Column) -> DataFrame:
    """Rows of asked for which the cache has no answer."""
    known = entries.filter(F.col("kind") == kind).select(F.col("key").alias("_key"))
    return asked.withColumn("_key", key).join(known, "_key", "left_anti").drop("_key")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


class Store:
    """Versions of a cache in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        if not self._files.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.path))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def _manifest(self) -> tuple[int, dict]:
        """(the last version's number, the last whole manifest)."""
        versions = self._manifests()
        for v in reversed(versions):
            stream = self._files.open(self._path(f"{self.path}/manifest-{v}.json"))
            try:
                return versions[-1], json.loads(bytes(stream.readAllBytes()).decode())
            except ValueError:
                continue  # its writer was lost
            finally:
                stream.close()
        return (versions[-1] if versions else 0), {"buckets": {}}

    def _create(self, version: int, manifest: dict) -> bool:
        """Whether this manifest became that version."""
        try:
            stream = self._files.create(self._path(f"{self.path}/manifest-{version}.json"), False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return True

    def _entries(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        folders = [b["folder"] for k, b in manifest["buckets"].items() if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._entries(self._manifest()[1])

    def save(self, answers: DataFrame, now: datetime, days: int = DAYS) -> int:
        """Adds answers and removes expired entries; the number of buckets that changed, which are written anew."""
        for _ in range(TRIES):
            version, manifest = self._manifest()
            changed = self._next(manifest, answers, now, days)
            if changed is None:
                return 0
            dirty, made = changed
            if self._create(version + 1, made):
                return dirty
        raise RuntimeError("the cache was saved by others each time")

    def _next(self, manifest: dict, answers: DataFrame, now: datetime, days: int) -> tuple[int, dict] | None:
        limit = now - timedelta(days=days)
        new = live(answers.select("kind", "key", "cached_at", "answer"), now, days)
        touched = {r[0] for r in new.select(_bucket(self.buckets)).distinct().collect()}  # at most as many as buckets
        touched |= {int(k) for k, b in manifest["buckets"].items() if b["oldest"] < _seconds(limit)}
        if not touched:
            return None
        before = self._entries(manifest, touched)
        after = newest(live(before, now, days), new)
        entry = F.struct("cached_at", "answer")
        both = before.select("kind", "key", entry.alias("b")).join(after.select("kind", "key", entry.alias("a")), ["kind", "key"], "full")
        differs = both.withColumn("bucket", _bucket(self.buckets)).filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket").distinct()
        dirty = {r.bucket for r in differs.collect()}
        if not dirty:
            return None
        folder = f"data-{uuid.uuid4().hex}"
        rows = after.withColumn("bucket", _bucket(self.buckets)).filter(F.col("bucket").isin(sorted(dirty)))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{ENTRIES}, bucket int").parquet(f"{self.path}/{folder}")
        oldest = {r.bucket: r.oldest for r in written.groupBy("bucket").agg(F.unix_timestamp(F.min("cached_at")).alias("oldest")).collect()}
        kept = {k: b for k, b in manifest["buckets"].items() if int(k) not in dirty}
        return len(dirty), {"buckets": {**kept, **{str(k): {"folder": f"{folder}/bucket={k}", "oldest": o} for k, o in oldest.items()}}}


def _seconds(at: datetime) -> float:
    return at.replace(tzinfo=timezone.utc).timestamp()
