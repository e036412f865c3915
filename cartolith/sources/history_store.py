"""A history table in buckets of its key: a batch rewrites the open versions of the buckets it touches and adds what it closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.history import apply_changes

_MANIFEST = "bucket int, batch long"


class HistoryStore:
    """Versions under ``path``: ``versions/batch=n/state=open|closed/bucket=b`` and, written last, ``manifest/batch=n``.

    The manifest names the batch that holds the open versions of each bucket, so a batch without a manifest never happened: it may be run again and
    overwrites what it left.  A batch that has one is recognised and skipped; numbers of batches must grow.  Closed versions are only ever added.
    The driver holds one row per bucket; ``buckets`` is fixed for a table and should keep a bucket's open versions to some 100 MB."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, key: str, seq: list[str] = (), user: Column | str | None = None, buckets: int = 64):
        self.spark, self.path, self.empty, self.key, self.seq, self.user, self.buckets = spark, path.rstrip("/"), empty, key, list(seq), user, buckets

    def _matches(self, pattern: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return [f.getPath().toString() for f in found or ()]

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def batches(self) -> list[int]:
        """Batches whose manifest is there, in order."""
        return sorted(int(p.split("/")[-2].removeprefix("batch=")) for p in self._matches("manifest/batch=*/_SUCCESS"))

    def places(self, batch: int | None = None) -> dict[int, int]:
        """Bucket -> batch that holds its open versions, after a batch (default: the last)."""
        done = self.batches()
        batch = done[-1] if batch is None and done else batch
        return {} if batch is None else {r[0]: r[1] for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/batch={batch}").collect()}

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.empty.where(F.lit(False))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.empty.schema.fields)
        return self.spark.read.schema(schema + ", batch long, state string, bucket int").option("basePath", f"{self.path}/versions").parquet(*paths)

    def open_versions(self, buckets: set[int] | None = None) -> DataFrame:
        """Open versions after the last batch, of some buckets or all; other buckets' files are not opened."""
        at = {b: n for b, n in self.places().items() if buckets is None or b in buckets}
        return self._read([f"{self.path}/versions/batch={n}/state=open/bucket={b}" for b, n in sorted(at.items())]).select(self.empty.columns)

    def read(self) -> DataFrame:
        """All versions after the last batch."""
        done = self.batches()
        closed = f"{self.path}/versions/batch=*/state=closed"
        if not done or not self._matches("versions/batch=*/state=closed"):
            return self.open_versions()
        return self.open_versions().unionByName(self._read([closed]).where(F.col("batch") <= done[-1]).select(self.empty.columns))

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame, batch: int) -> bool:
        """Apply a batch of changes; False when it had been applied before."""
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        touched = {r[0] for r in changes.select(self.bucket_of()).distinct().collect()}   # at most `buckets` numbers
        places = self.places()
        after = apply_changes(self.open_versions(touched), changes, self.key, seq=self.seq, user=self.user).select(self.empty.columns)
        out = after.withColumns({"state": F.when(F.col("valid_to").isNull(), "open").otherwise("closed"), "bucket": self.bucket_of()})
        made = f"{self.path}/versions/batch={batch}"
        # full files per bucket; the adaptive plan splits a bucket that one key has filled
        out.hint("rebalance", "state", "bucket").write.mode("overwrite").partitionBy("state", "bucket").parquet(made)
        held = {int(p.rsplit("=", 1)[1]) for p in self._matches(f"versions/batch={batch}/state=open/bucket=*")}
        places = {b: n for b, n in places.items() if b not in touched} | {b: batch for b in held}
        self.spark.createDataFrame(sorted(places.items()), _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")
        return True

    def vacuum(self, keep: int = 1) -> int:
        """Remove open versions that none of the last ``keep`` manifests names, and older manifests; number of folders removed.

        Readers that began before those batches must be done."""
        done = self.batches()
        named = {(n, b) for batch in done[-keep:] for b, n in self.places(batch).items()}
        old = [f"{self.path}/manifest/batch={n}" for n in done[:-keep]]
        for p in self._matches("versions/batch=*/state=open/bucket=*"):
            n, b = (int(p.split("/")[i].rsplit("=", 1)[1]) for i in (-3, -1))
            if done and n <= done[-1] and (n, b) not in named:
                old.append(p)
        for p in old:
            self._delete(p)
        return len(old)
