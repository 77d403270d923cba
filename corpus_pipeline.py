"""From raw documents to packed training sequences: five stages, each over all that its predecessor kept.

1. toxicity: documents whose score is at least the threshold go.
2. near_duplicates: of each group of documents that word 5-grams link at a similarity of 0.8 or more, the one of least doc_id stays.
3. decontamination: documents of which a twentieth or more stands in benchmark windows go.
4. secrets: every secret's span is masked in the text; n_chars follows.
5. packing: what is left as token ids in sequences of at most 4096.

The first four return the columns of documents.  Rows that a stage cannot judge stay: null and empty texts are neither toxic nor contaminated,
and are nobody's near duplicate.  Of rows with one doc_id and one text one stays; other texts under that doc_id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from delve.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from delve.llm.common import materialise, table
from delve.llm.tokens import default_file


#: Before the names of columns that a stage adds for itself, so that none of docs is hidden.
OWN = "_stage_"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under the threshold; the model learns from the labels of docs."""
    table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, prefix=OWN).where(F.col(f"{OWN}predicted") == 0).select(*docs.columns)


def _nodes(docs: DataFrame) -> DataFrame:
    """docs with a number for each document: its doc_id or, where a doc_id has several texts, the place of doc_id and text in their order."""
    node, key, text = f"{OWN}node", f"{OWN}key", f"{OWN}text"
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), text: F.xxhash64("text")})
    keys = materialise(marked.where(F.col(key).isNotNull()).select(key, text).distinct(), "keys")
    if keys.groupBy(key).count().where("count > 1").isEmpty():
        return marked.withColumn(node, F.col(key)).drop(key, text)
    placed = keys.orderBy(key, text).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    placed = materialise(docs.sparkSession.createDataFrame(placed, f"{key} long, {text} long, {node} long"), "nodes")
    return marked.join(placed, [key, text], "left").drop(key, text)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the row whose number is the class's."""
    node, copy = f"{OWN}node", f"{OWN}copy"
    nodes = _nodes(docs)
    classes = jaccard_join.join(nodes.select(F.col(node).alias("doc_id"), "text")).where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias(node)).distinct()
    kept = nodes.join(classes, node, "left_anti").select(*docs.columns)
    # what is left of one doc_id and one text are copies of each other
    order = Window.partitionBy("doc_id", "text").orderBy(*(x for x in ("source", "lang", "n_chars") if x in docs.columns), F.lit(0))
    numbered = kept.where("doc_id is not null").withColumn(copy, F.row_number().over(order)).where(f"{copy} = 1").drop(copy)
    return numbered.unionByName(kept.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), prefix=OWN)
    return found.where(~decontaminate.contaminated(f"{OWN}n_hit", f"{OWN}n_words")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.masked(docs, default_file())
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    return packing.pack(docs, default_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: No stage but decontamination is SQL's to express; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
