"""A corpus from raw documents: quality rules, line dedup, near-dedup, mixing, BPE."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, nearcopies, quality
from tidemark.llm.common import forget, table, written
from tidemark.llm.queries import TOKENIZER


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts have too few words and go; repeated rows are judged each."""
    return quality.quality_cascade(docs).where("kept").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that other documents hold; n_chars follows. A document that loses all its lines goes.

    Of documents that share a line the one with the largest id keeps it. Null texts stay as empty ones.
    """
    out = lines.dedup_lines(docs).where("n_dropped = 0 OR length(kept) > 0")
    kept = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*[kept[c].alias(c) if c in kept else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with a similarity of 0.8 at least.

    The smallest id of a group stays; all texts without words are one group; of repeated rows one stays.
    """
    return nearcopies.drop_near_copies(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies that the mix takes of each document, shuffled into shards. Null sources are one source, the last."""
    return mixing.mix_table(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that the mix takes; null and empty texts have none."""
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [("quality_rules", keep_quality), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("bpe", encode_text)]

#: SQL has neither the mix's draws nor BPE; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage before it is written to the shared folder and read again; older tables are removed.

    An empty table of documents gives no rows.
    """
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        before = path
        docs, path = written(stage(spark, docs, sf_dir))
        if before:
            forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
