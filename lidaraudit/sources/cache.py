"""A cache of answers that several runs may write at once.

A part is a folder of Parquet for one range of keys. A writer prepares its parts in a folder of its own and makes each
visible by one rename to the next number of its range, which fails if another writer has taken that number. Then it
drops what the other has stored and tries the next number, so each key is stored once. Readers see whole parts only; what
a killed writer has prepared is never seen. The rename has to be atomic and refuse an existing target, as those of
local disks and HDFS do; plain object stores don't.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys are dealt to ranges by a hash.
RANGES = "0123456789abcdef"
ANSWER = "key string, candidate_type string, response string, seconds double, stored_at timestamp"
NAMES = [c.split()[0] for c in ANSWER.split(", ")]


class Folder:
    """A folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path.getFileSystem(conf)
        self.path = self.fs.makeQualified(self.path)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def parts(self, where: str) -> list[int]:
        at = self.jvm.org.apache.hadoop.fs.Path(self.path, where)
        return sorted(int(s.getPath().getName()) for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def taken(self, source: str, target: str) -> bool:
        """Whether source could be made target, which nobody had taken."""
        a, b = (self.jvm.org.apache.hadoop.fs.Path(self.path, x) for x in (source, target))
        self.fs.mkdirs(b.getParent())
        if self.fs.getUri().getScheme() == "file":
            try:
                os.rename(a.toUri().getPath(), b.toUri().getPath())
            except OSError:
                return False
            return True
        try:
            self.context.rename(a, b, self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def drop(self, where: str) -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.path, where), True)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The answers that are stored: ANSWER, a row for each key."""
    folder = Folder(spark, path)
    found = [f"{folder.path}/committed/{r}/{n}" for r in RANGES for n in folder.parts(f"committed/{r}")]
    return spark.read.schema(ANSWER).parquet(*found) if found else spark.createDataFrame([], ANSWER)


def _range(folder: Folder, answers: DataFrame, r: str, seen: int, prepared: str, attempts: int) -> int:
    """Makes the prepared part of range r visible as the number after `seen`; returns that number."""
    spark = answers.sparkSession
    for again in range(attempts):
        if folder.taken(prepared, f"committed/{r}/{seen + 1}"):
            return seen + 1
        others = [n for n in folder.parts(f"committed/{r}") if n > seen]
        known = spark.read.schema(ANSWER).parquet(*[f"{folder.path}/committed/{r}/{n}" for n in others]).select("key")
        seen, old, prepared = max(others), prepared, f"{prepared.rpartition('/')[0]}/{r}-{again}"
        spark.read.schema(ANSWER).parquet(f"{folder.path}/{old}").join(known, "key", "left_anti").write.parquet(f"{folder.path}/{prepared}")
    raise RuntimeError(f"range {r} of {folder.path} was taken {attempts} times by others")


def save(answers: DataFrame, path: str, attempts: int = 100) -> None:
    """Stores the answers of status `verified` (ANSWER) whose keys aren't there; of equal keys the latest."""
    spark = answers.sparkSession
    folder = Folder(spark, path)
    seen = {r: max(folder.parts(f"committed/{r}"), default=0) for r in RANGES}
    own = f"preparing/{uuid.uuid4().hex}"
    latest = answers.where("status = 'verified'").groupBy("key").agg(F.max_by(F.struct(*NAMES), F.struct("stored_at", "response")).alias("a")).select("a.*")
    new = latest.join(read(spark, path).select("key"), "key", "left_anti").withColumn("range", F.lower(F.conv((F.crc32(F.col("key").cast("binary")) % len(RANGES)).cast("string"), 10, 16)))
    new.select(*NAMES, "range").repartition("range").write.partitionBy("range").parquet(f"{folder.path}/{own}")
    for r in RANGES:
        prepared = f"{own}/range={r}"
        if folder.fs.exists(folder.jvm.org.apache.hadoop.fs.Path(folder.path, prepared)):
            _range(folder, answers, r, seen[r], prepared, attempts)
    folder.drop(own)
