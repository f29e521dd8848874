"""Entities (capitalised words) of documents, and the graph of the entities of a document pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: what counts as an entity.
ENTITY = r"\b[A-Z][a-zA-Z0-9_\-]+\b"


def extract_entities(docs: DataFrame) -> DataFrame:
    """doc_id, entity: the distinct entities of each document, made distinct before anything is shuffled."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){ENTITY}"), 0))
    return docs.select("doc_id", F.explode(found).alias("entity"))


def entity_nodes(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (pair_id, doc1, doc2) -> pair_id, entity, in_doc1, in_doc2."""
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.col("doc1").alias("doc_id"), F.lit(1).alias("side")), F.struct(F.col("doc2").alias("doc_id"), F.lit(2).alias("side")))).alias("s")).select("pair_id", "s.*")
    found = sides.join(extract_entities(docs), "doc_id")
    return found.groupBy("pair_id", "entity").agg(F.bool_or(F.col("side") == 1).alias("in_doc1"), F.bool_or(F.col("side") == 2).alias("in_doc2"))


def common_edges(nodes: DataFrame) -> DataFrame:
    """An edge for each entity that both documents of a pair name."""
    return nodes.filter("in_doc1 and in_doc2").select("pair_id", F.col("entity").alias("source"), F.col("entity").alias("target"), F.lit("common").alias("relation"))
