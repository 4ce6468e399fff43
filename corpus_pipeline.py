"""From raw documents to shards for training, in five stages.

Each stage works on all that the one before it kept and is written before the next one reads it, so a lost
executor never costs more than a stage.

Defined cases, by stage: language_id drops null and blank texts and those without a letter; near_dedup keeps of equal
texts, repeated rows and near copies the row with the least doc_id (a row without one only if alone); decontaminate
keeps texts that hold nothing of the benchmark, however long; mix_sources takes null sources for one source and repeats
rows of small ones up to three times; shard returns (doc_id, size, text_crc32, law, shard, slot, grown_shard). Columns
beyond those of documents ride along up to the last stage, but for names that start with `__`; ties never drop a row;
an empty table gives empty stages.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.llm import decontamination, langid, mixing, sharding, simhash
from gridlore.llm.common import noting, remove, stage, table

def least_sure(languages: int) -> float:
    """A text is rejected if no language is found in it (no letter), or if the pooled probability of the best one is below this: 0.4,
    or with more than four languages 1.6 times what each would get by chance."""
    return min(0.4, 1.6 / max(1, languages))


SHARDS = 24
#: Rows of doomed documents up to which their keys are broadcast.
SMALL_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the network knows for one; without labels to learn from, all that have a letter."""
    model = langid.Identifier(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = model.label(docs, pred="__lang", score="__sure")
    return marked.filter((F.col("__lang") != langid.UNKNOWN) & (F.col("__sure") >= least_sure(len(model.languages)))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies."""
    return simhash.representatives(docs).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a word in 20 or more lies in a passage of the benchmark."""
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    hit = decontamination.scan(docs.select(key.alias("__key"), "text"), table(spark, sf_dir, "benchmark"), key="__key")
    doomed = stage(hit.filter("contaminated").select("__key").distinct(), "contaminated")
    if doomed.count() <= SMALL_ROWS:
        doomed = F.broadcast(doomed)
    return docs.withColumn("__key", key).join(doomed, "__key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives sources their shares of the words; documents of small sources come up to three times."""
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign(docs, SHARDS, "bytes")


_PLAIN = (language_id, near_dedup, decontaminate, mix_sources, shard)
#: Folders that each stage staged when it last ran on its own. What it returned has been written when the next stage is called, which
#: deletes them; those of the last stage stay.
_staged: list[list[str]] = [[] for _ in _PLAIN]


def _tidy(n: int, f):
    """Stage n, for callers who write what it returns before they call the next one: it first deletes what the one before it staged."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if n:
            remove(spark, _staged[n - 1])
        _staged[n] = []
        with noting(_staged[n]):
            return f(spark, docs, sf_dir)

    return run


STAGES = [(f.__name__, _tidy(n, f)) for n, f in enumerate(_PLAIN)]

#: The network and the shingles' hashes have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`. Folders are kept track of by run, so one run never deletes what another's result still reads."""
    docs, spent = table(spark, sf_dir, "documents"), []
    for f in _PLAIN[:-1]:
        mine: list[str] = []
        with noting(mine):
            rows = f(spark, docs, sf_dir)
        with noting(written := []):
            docs = stage(rows, f.__name__)
        remove(spark, mine + spent)
        spent = written
    return shard(spark, docs, sf_dir)
