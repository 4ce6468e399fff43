"""Token counts: an exact histogram of documents by encoded length.

Lengths are numbers of tokens of a public byte-level BPE (a rank file in tiktoken's form; its path is a
parameter, it is read once on the driver). Documents with the same length are one row of the histogram, summed
before anything is shuffled; suffix sums over it answer, for every context limit, how many documents and tokens
are at or above it, how many tokens are left if documents are cut there, and the share of documents that fit.

Defined cases: null and empty texts have length 0 and are counted; very long texts are encoded whole; repeated rows
count each, and keys, null or tied, play no part; an empty table gives an empty histogram; other columns are not read
but those to keep, whatever their names.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridlore.llm.common import lean

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this public vocabulary cuts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ready: dict[int, object] = {}


def _encoding(raw: bytes):
    """The encoding of a rank file's bytes, made once in a process."""
    if hash(raw) not in _ready:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ready[hash(raw)] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ready[hash(raw)]


def lengths(docs: DataFrame, text: str = "text", keep=("doc_id",), ranks: str = RANKS, name: str = "length") -> DataFrame:
    """The columns to keep and each document's number of tokens."""
    keep = list(keep)
    sent = docs.sparkSession.sparkContext.broadcast(Path(ranks).read_bytes())

    def run(batches):
        encoding = _encoding(sent.value)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.array(n, np.int64))], names=[*keep, name])

    schema = StructType([*docs.select(*keep).schema.fields]).add(name, "long")
    return lean(docs).select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def histogram(sizes: DataFrame, name: str = "length") -> DataFrame:
    """A row for each length that occurs: documents, tokens, documents and tokens at least that long, tokens if all are cut at
    that length, tokens cut off, and the share of documents that are no longer."""
    h = sizes.groupBy(name).agg(F.count("*").alias("documents")).withColumn("tokens", F.col("documents") * F.col(name))
    down = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # rows are lengths, not documents
    n = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # A suffix sum is the total without the prefix: one running sum serves both, in time linear in the lengths.
    upto, tokens = F.sum("documents").over(down), F.sum("tokens").over(down)
    h = h.select(F.col(name).alias("length"), "documents", "tokens", upto.alias("upto"), tokens.alias("tokens_upto"), F.sum("tokens").over(n).alias("total"), F.sum("documents").over(n).alias("all"))
    h = h.withColumn("documents_at_least", F.col("all") - F.col("upto") + F.col("documents")).withColumn("tokens_at_least", F.col("total") - F.col("tokens_upto") + F.col("tokens"))
    cut = F.col("tokens_at_least") - F.col("documents_at_least") * F.col("length")
    return h.select(
        "length", "documents", "tokens", "documents_at_least", "tokens_at_least", (F.col("total") - cut).alias("truncated_tokens"), cut.alias("tokens_cut"),
        (F.col("upto") / F.col("all")).alias("share_fitting"),
    )


def at_limits(hist: DataFrame, limits: DataFrame, limit: str = "limit") -> DataFrame:
    """Answers of a histogram for any context limits (a column of longs): documents that fit, documents and tokens cut, tokens left."""
    asked = limits.select(F.col(limit).cast("long").alias("at"), F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("tokens"), F.lit(1).alias("asked")).distinct()
    rows = hist.select(F.col("length").cast("long").alias("at"), "documents", "tokens", F.lit(0).alias("asked")).unionByName(asked)
    upto = Window.orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # rows are lengths and limits
    everything = Window.orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = rows.select("at", "asked", *(F.sum(c).over(w).alias(f"{c}_{n}") for c in ("documents", "tokens") for n, w in (("fit", upto), ("all", everything))))
    known, cut = F.col("at").isNotNull(), F.col("documents_all") - F.col("documents_fit")
    return m.filter("asked = 1").select(
        F.col("at").alias(limit), F.when(known, F.col("documents_fit")).otherwise(0).alias("documents_fitting"), F.when(known, cut).otherwise(0).alias("documents_cut"),
        F.when(known, F.col("tokens_fit") + cut * F.col("at")).otherwise(F.col("tokens_all")).alias("truncated_tokens"),
    )


def quantiles(hist: DataFrame, at=(0.5, 0.9, 0.99)) -> DataFrame:
    """The least length that at least a share of all documents do not exceed."""
    return hist.agg(*(F.min(F.when(F.col("share_fitting") >= q, F.col("length"))).alias(f"q{q:g}") for q in at))
