"""From raw documents to shards: quality rules, near-duplicate removal,
benchmark decontamination, mixing to target weights and sharding.

Each stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard, mixing, quality, sharding
from millrace.llm.common import Scratch, chosen, restored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the certified cutoffs reject. Null, empty
    and very short texts fail; very long ones are judged as a whole; repeated rows alike.
    An empty table stays one, and columns of any names pass unchanged."""
    judged = quality.judge(chosen(docs, docs.columns, doc_id="doc_id", text="text", lang="lang"), table(spark, sf_dir, "labels"), ["row"])
    return restored(judged.where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of linked documents. Rows
    are judged by their texts, those without an id too; texts without words stay."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none;
    very long ones are searched whole, repeated rows each. An empty table stays one, an
    empty benchmark removes nothing, and columns of any names pass unchanged."""
    found = decontamination.find_benchmark(chosen(docs, docs.columns, text="text"), table(spark, sf_dir, "benchmark"), carry=["row"])
    return restored(found.where(F.size("hits") == 0), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' rates say; a null source is one. Texts without
    words are copied like others of their source, and very long ones count whole; equal
    rows draw apart. An empty table stays one, and columns of any names pass unchanged."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shards. A text longer than a shard, and equal rows that
    together are, get pages of their own; null and empty texts have no bytes. An empty
    table stays one; columns named like the new ones are replaced."""
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]



def over(sql: str, kept: str) -> str:
    """An operator's SQL over the documents that an earlier stage kept."""
    return re.sub(r"\bdocuments\b", kept, sql.strip())


#: For tables where doc_ids are unique and not null. Stages by their operators' SQL.
ORACLE_SQL = f"""
WITH ruled AS MATERIALIZED (
  SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM ({quality.SQL.strip()}) WHERE kept)
), single AS MATERIALIZED (
  SELECT * FROM ruled WHERE doc_id IN (SELECT doc_id FROM ({over(jaccard.SQL, "ruled")}) WHERE doc_id = component_id)
), clean AS MATERIALIZED (
  SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM ({over(decontamination.SQL, "single")}) WHERE contaminated)
), copied AS MATERIALIZED (
  SELECT c.* FROM clean c JOIN (SELECT doc_id, unnest(range(copies)) AS copy FROM ({over(mixing.SQL, "clean")})) m USING (doc_id)
), shards AS MATERIALIZED (
  SELECT DISTINCT doc_id, bytes, shard, page, shard_bytes FROM ({over(sharding.SQL, "copied")})
)
SELECT copied.*, bytes, shard, page, shard_bytes FROM copied JOIN shards USING (doc_id)
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
