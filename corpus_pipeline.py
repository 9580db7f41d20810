"""A corpus pipeline: documents pass quality rules, near-dedup, decontamination and mixing, and are written as token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import decontam, mixing, neardup, quality, tokens
from meterloom.llm.shared import new_folder, own_folders, remove_folders


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with all their columns.

    Null and empty texts have under ten words and go; rows of equal texts stay or go together, whatever
    their ids; long texts are judged whole; an empty table gives no rows.
    """
    return quality.judge(docs).where("kept").select("record.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id, with all its columns.

    Five words and a similarity of 0.8, the operator's own parameters. Texts without words are no
    copies of each other; null ids and ids of several rows are judged row by row; of rows that are
    equal in id and text one stays.
    """
    return neardup.without_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't match the benchmark in a word of twenty or more, with all their columns.

    Texts without words match nothing and stay, as do all where the benchmark is empty; rows that are
    equal in id and text stay or go together.
    """
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same, in a random order, in which they are laid out.

    A null source is a source of its own, and one without bytes keeps its documents as they are; a null
    id draws by its text; rows that repeat an id draw the same number.
    """
    return mixing.mix_sources(docs).select("record.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, in the order in which ``docs`` is stored, as a row for each document read back from them.

    So the random order of mixing is that of the files. A null or empty text has the end id alone, a
    null id stays null, repeated rows are encoded each; other columns are left out.
    """
    return tokens.encoded(docs, in_order=False)


STAGES = [
    ("quality rules", keep_good),
    ("near duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix),
    ("token ids", tokenize),
]

#: Expectation-maximisation, minhashes and the tokenizer are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again.

    Once a stage is written, the tables that its operator left in the shared folder are removed, and so
    is what the stage before had written; the last stage's table and token files stay.
    """
    folder = new_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before = own_folders()
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if i < len(STAGES) - 1:
            remove_folders(own_folders() - before)
        if i:
            remove_folders({f"{folder}/{i - 1}"})
    return docs
