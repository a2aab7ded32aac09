"""A corpus pipeline of five stages, each one an operator of ``gossamer.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``docs`` as they came, with
whatever names beside doc_id, text, source and lang; rows keep null columns. An empty table goes
through every stage, and very long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gossamer.llm import decontaminate, jaccard, mixing, quality, tokenbin
from gossamer.llm.groups import quoted
from gossamer.session import materialize, table

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, NUM, DEN = 5, 80, 100
#: Words a worker remembers in the last stage: few, as workers hold memory of earlier stages.
MEMO_WORDS = 100_000


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` has not."""
    while name in docs.columns:
        name = "_" + name
    return name


def columns(docs: DataFrame) -> list[Column]:
    return [quoted(c) for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under the threshold) go."""
    stats = materialize(quality.features(docs.select("doc_id", "text")), "pipeline-stats")
    model = quality.fit_quality(stats, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    scored = quality.score_documents(docs, model, score_col=score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id.

    Rows of one id are one document: the row with the smallest text stays (null before all others), of
    equal texts the one with the smallest hash of all columns. Rows without an id, and texts
    without words, are duplicates of nothing and stay.
    """
    classes = materialize(jaccard.jaccard_classes(docs.select("doc_id", "text"), NUM, DEN, SHINGLE), "pipeline-classes")
    key = free_name(docs, "gone_id")
    gone = classes.where("component_id <> id").select(F.col("id").alias(key)).distinct()
    few = gone.limit(jaccard.BROADCAST_IDS + 1).count() <= jaccard.BROADCAST_IDS
    out = docs.join(F.broadcast(gone) if few else gone, quoted("doc_id").cast("long") == F.col(key), "left_anti").select(*columns(docs))
    again = materialize(classes.where("id is not null").groupBy(F.col("id").alias(key)).count().where("count > 1").select(key), "pipeline-ids")
    if again.isEmpty():
        return out
    on = quoted("doc_id").cast("long") == F.col(key)
    sortable = [quoted(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = F.min_by(F.struct(*columns(docs)), F.struct(quoted("text"), F.xxhash64(*sortable))).alias("row")
    one = out.join(again, on, "left_semi").groupBy(quoted("doc_id").cast("long")).agg(first).select("row.*")
    return out.join(again, on, "left_anti").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    hits = free_name(docs, "benchmark_hits")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), out_col=hits)
    return found.where(F.size(hits) == 0).select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by their calibrated probabilities."""
    rows = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.n_words(F.col("text")).alias("n_tokens"))
    return mixing.mix(rows).where("kept").select("row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, described as read back."""
    return tokenbin.tokenize_to_files(docs, tokenbin.default_tokenizer(), 2, memo_words=MEMO_WORDS).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("token files", write_token_files),
]

#: No SQL for trees, alignment and tokenizers; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-stage")
    return STAGES[-1][1](spark, docs, sf_dir)
