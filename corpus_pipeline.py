"""The corpus pipeline: five stages, each one operator, each on all that the one before kept, Parquet in between.

Null and empty texts go through every stage but mixing, which draws only documents with words; null ids, null sources and
repeated ids are kept apart by text. An empty table gives an empty result. Columns beyond those of documents, whatever their
names, are carried to the mix.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import jaccard, mixing, privacy, sentencepiece, toxicity
from tidemark.llm.common import free_name, partitions, shared_dir, ship, table, written
from tidemark.llm.queries import PSEUDONYM_KEY, piece_model


SHARDS = 16  # mix_sources' own number
#: Where a drawn row stands: its output shard, the place of its block there, its place in the block. A column of the
#: documents with such a name stays as it is; ours then gets underscores.
MIXED = ("mix_shard", "mix_block", "mix_place")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier calls toxic."""
    # The classifier's own columns stand beside a struct of all others, so that no column is replaced.
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])
    scored = toxicity.score_toxicity(docs.select("doc_id", "text", rest.alias("rest")), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("doc_id", "text", "rest.*").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of links: the one that gives it its id. Documents without an id stay.

    A document is an id and a text's set of shingles: rows that share an id are judged each by its own, and are one where both are equal.
    """
    ship(spark)
    doc, point, lost = (free_name(docs.columns, c) for c in ("_doc", "_point", "_lost"))
    found = jaccard.join_components(docs).where("doc_id is not null")
    texts = found.groupBy("doc_id", "point", "root", "component_id").agg(F.count("*").alias("n"))
    # Where several texts of a component have its id, the least point stays.
    alike = Window.partitionBy("doc_id", "component_id", "root").orderBy("point")
    again = F.col("point").isNotNull() & (F.row_number().over(alike) > 1)
    texts = written(texts.withColumn("gone", (F.col("doc_id") != F.col("component_id")) | again))
    ids = written(texts.groupBy("doc_id").agg(F.sum("n").alias("n"), F.every("gone").alias("gone")).where("gone or n > 1").select(F.col("doc_id").alias(doc), F.col("gone").alias(lost)))
    id_of = docs["doc_id"].cast("long")
    kept, several = docs.join(ids, id_of == F.col(doc), "left_anti"), ids.where(f"not {lost}")
    if several.limit(1).count():  # ids on several rows, not all of which go
        shared = jaccard.with_point(docs.join(several, id_of == F.col(doc), "left_semi"), point)
        gone = texts.where("gone").select(F.col("doc_id").alias(doc), F.col("point").alias(lost))
        shared = shared.join(gone, (F.col("doc_id").cast("long") == F.col(doc)) & F.col(point).eqNullSafe(F.col(lost)), "left_anti")
        # Of rows alike in id and text the least in all other columns stays, so that reruns agree.
        rest = F.struct(*[F.to_json(F.struct(F.col(c))).alias(f"c{i}") for i, c in enumerate(docs.columns)])
        least = Window.partitionBy("doc_id", point).orderBy(rest)
        shared = shared.withColumn(lost, F.row_number().over(least)).where(F.col(lost) == 1)
        kept = kept.unionByName(shared.select(*docs.columns))
    return kept


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms for personal data; n_chars follows the text."""
    hidden = privacy.pseudonymise(docs, PSEUDONYM_KEY, count_col=None)
    return hidden.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws every source to its target: a row for each time that a document is drawn, always whole, in its shard.

    Sorting by MIXED gives the order of training; rows are written in it. A source goes past its target by less than a document.
    """
    shard, block, place = (free_name(docs.columns, c) for c in MIXED)
    rows = mixing.mix_sources(docs, keep=tuple(docs.columns)).select("kept", "source", "block", F.explode("draws").alias("draw"))
    order = F.xxhash64(F.lit(17), "source", "block", "draw.epoch")  # the blocks of all sources in one permuted order
    rows = rows.select("kept.*", F.col("draw.shard").alias(shard), order.alias(block), F.col("draw.place").alias(place))
    # Each partition is a run of one shard's blocks: the shard is cut into as many equal ranges of its block order.
    pieces = -(-partitions(spark) // SHARDS)
    piece = F.least(F.floor((F.col(block) / F.lit(2.0**64) + 0.5) * pieces), F.lit(pieces - 1))
    return rows.repartitionById(SHARDS * pieces, (F.col(shard) * pieces + piece).cast("int")).sortWithinPartitions(shard, block, place, "doc_id")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every drawn text, with its place in the mix."""
    ship(spark)
    return sentencepiece.encode(docs, piece_model(spark)).select("doc_id", "source", "n_tokens", "round_trip", "ids", *[c for c in docs.columns if c.rstrip("_") in MIXED])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("pii", hide_personal),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: The learned classifier, the keyed permutations and the search for pieces have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
            docs.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
    return docs
