"""What the corpus operators share: the shared folder, staged tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; else the context's checkpoint folder.

    Only where all is one process (a local master, as in tests) a folder of its own will do; elsewhere it must be set.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="gridlore-"))
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of a batch that goes to Python. Texts are long: Spark's own default of 10,000 rows can be hundreds of MB.
BATCH_ROWS = 1000


def lean(df: DataFrame) -> DataFrame:
    """df, after the session's batches for Python have been made smaller, unless they were set by hand."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


_kept: list[str] | None = None


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here, and a
    lost executor costs no recomputation."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    if _kept is not None:
        _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def noting(paths: list[str]):
    """Within, the folders of staged tables are added to paths, for `remove` once nothing reads them any more."""
    global _kept
    before, _kept = _kept, paths
    try:
        yield
    finally:
        _kept = before


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged folders, in whatever store they are."""
    while paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes that separate words.
SPACES = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text, off the Arrow buffers: no string is made. Null: 0."""
    t = texts.cast(pa.large_binary())
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    ends = np.frombuffer(t.buffers()[1], np.int64, n + 1, t.offset * 8)
    raw = np.frombuffer(t.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    space = SPACES[raw]
    begins = ~space
    begins[1:] &= space[:-1]
    first = (ends[:-1] - ends[0])[ends[:-1] < ends[1:]]
    begins[first] = ~space[first]  # a text's first character does not go on from the text before
    upto = np.concatenate(([0], np.cumsum(begins)))
    return upto[ends[1:] - ends[0]] - upto[ends[:-1] - ends[0]]


def with_word_count(docs: DataFrame, text: str, keep, name: str) -> DataFrame:
    """The columns to keep and the number of words of the text, as name."""
    keep = list(keep)

    def run(batches):
        for b in batches:
            n = count_words(b.column(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, name])

    rows = docs.select(*keep)
    return lean(docs).select(*keep, F.col(text).alias("__text")).mapInArrow(run, StructType([*rows.schema.fields]).add(name, "long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
