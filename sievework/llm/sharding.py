"""Sharding by size-tiered compaction (operator 8, DataFrame functions only).

Arrivals are appended as runs of small immutable Parquet shards. A manifest lists the live shards; a version of it is
committed by renaming a finished file to the next version's name, which fails if another writer took it, so readers
see a whole version or the one before. Compaction puts shards into tiers by size, a tier being `fanout` times the one
before, and merges a tier that has `fanout` shards or more into files of about the target size. Merging reads the
shards and writes them through a narrow coalesce, without a shuffle. Shards that the newest `keep_versions` manifests
do not name are deleted: at once if an older manifest names them, and after `grace_hours` if none does, as those of a
writer that failed before its commit. Two versions are kept by default, so that readers of the one before can end.

Rows, repeated ones too, pass unchanged with all their columns; nulls, empty and very long texts are data like any
other. An empty arrival commits a version without new shards; an empty store reads as an empty table.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, fresh_path, table


class ShardStore:
    """A folder of immutable shards under versioned manifests."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = 128 << 20, fanout: int = 4, shard_rows: int = 20_000, keep_versions: int = 2, grace_hours: float = 24):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fanout, self.shard_rows, self.keep_versions, self.grace_hours = target_bytes, fanout, shard_rows, keep_versions, grace_hours

    def versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the newest."""
        have = self.versions()
        version = version if version is not None else have[-1] if have else 0
        if not version:
            return {"version": 0, "shards": []}
        fs, p = filesystem(self.spark, f"{self.root}/manifests/v{version:08d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict]) -> dict:
        """Publish `shards` as the version after `base`; an error if that version exists."""
        version = base["version"] + 1
        new = {"version": version, "shards": shards}
        fs, draft = filesystem(self.spark, f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        sc = self.spark.sparkContext
        final = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/v{version:08d}.json")
        options = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(draft, final, options)
        return new

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        """Write a run; its shards with their bytes and rows."""
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(run)
        counts = self.spark.read.schema(self.schema).parquet(run).groupBy(F.input_file_name().alias("f")).count().collect()
        rows_of = {r["f"].rsplit("/", 1)[1]: r["count"] for r in counts}
        fs, p = filesystem(self.spark, run)
        files = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")]
        return [{"path": f"{run}/{name}", "bytes": size, "rows": rows_of[name]} for name, size in sorted(files) if rows_of.get(name)]

    def append(self, df: DataFrame) -> dict:
        """Add an arrival as small shards and commit a version with them."""
        base = self.manifest()
        return self.commit(base, base["shards"] + self._write(df.select(*self.schema.names), self.shard_rows))

    def tier(self, size: int) -> int:
        """0 for shards of the target size or more, else how many times fanout fits between."""
        return max(0, math.ceil(math.log(self.target_bytes / max(size, 1), self.fanout) - 0.5))

    def compact(self) -> dict:
        """Merge full tiers, smallest shards first, until none is left; commits a version per merge."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[dict]] = {}
            for s in now["shards"]:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
            full = [t for t, shards in tiers.items() if t and len(shards) >= self.fanout]
            if not full:
                return now
            merged = tiers[max(full)]
            files = max(1, round(sum(s["bytes"] for s in merged) / self.target_bytes))
            if files >= len(merged):
                return now
            gone = {s["path"] for s in merged}
            new = self._write(self.spark.read.schema(self.schema).parquet(*sorted(gone)).coalesce(files))
            self.commit(now, [s for s in now["shards"] if s["path"] not in gone] + new)
            self.vacuum()

    def vacuum(self) -> None:
        """Delete manifests older than the newest keep_versions, and shards that none of those names."""
        have = self.versions()
        live = {s["path"] for v in have[-self.keep_versions :] for s in self.manifest(v)["shards"]}
        for v in have[: -self.keep_versions]:
            for s in self.manifest(v)["shards"]:
                if s["path"] not in live:
                    fs, p = filesystem(self.spark, s["path"])
                    fs.delete(p, False)
            fs, p = filesystem(self.spark, f"{self.root}/manifests/v{v:08d}.json")
            fs.delete(p, False)
        fs, p = filesystem(self.spark, f"{self.root}/data")
        runs = {path.rsplit("/", 2)[1] for path in live}
        old = (time.time() - 3600 * self.grace_hours) * 1000
        for s in fs.listStatus(p) if fs.exists(p) else ():
            if s.getPath().getName() not in runs and s.getModificationTime() < old:
                fs.delete(s.getPath(), True)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [s["path"] for s in self.manifest(version)["shards"]]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches of unequal size, are compacted, and are read back from the last version."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, fresh_path(spark, "shards"), docs.schema, target_bytes=64 << 20, keep_versions=1)  # no one reads the versions between
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for first, last in ((0, 3), (4, 5), (6, 6), (7, 7)):
        store.append(docs.filter(part.between(first, last)))
    version = store.compact()["version"]
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def oracle_sql() -> str:
    return "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
