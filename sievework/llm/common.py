"""What the operators of this subpackage share: shared storage, text helpers, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}

#: A side of a join is broadcast only when a count has shown it to have at most this many rows.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch that goes to Python, but for its last row. Spark's 64 MB are held several times over, by the
#: JVM outside its heap and by the worker, in every task; an executor keeps what it has once taken.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session on one machine that names none (tests) gets one of its own."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="spark-sievework-")
    return _OWN_DIR[app]


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: computed once, with its lineage cut."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing lazy reads any more."""
    for df in tables:
        for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            fs, p = filesystem(df.sparkSession, top)
            fs.delete(p, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; else df as it is, so that the join shuffles."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(rows + 1)) <= rows else df


def bound_batches(spark: SparkSession) -> None:
    """From now on, Arrow batches of this session hold ARROW_BYTES at most, or less if less is set; rows stay whole."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if now.startswith("-") or spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.split() splits at just those six characters."""
    return text.encode().split() if text else []


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    bound = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each window of k words; a shorter text is one shingle; no words, none."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        acc = mix64(acc + word_hashes[j : n - width + 1 + j] * _ODD[j % 5])
    return acc


def batches(it: Iterator, bytes_limit: int = 8 << 20) -> Iterator:
    """Arrow batches cut further, so that a batch of very long texts stays small in Python."""
    for b in it:
        step = max(1, int(b.num_rows * bytes_limit / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
