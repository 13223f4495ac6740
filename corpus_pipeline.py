"""Documents to training sequences: language ID, line dedup, near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. ``run`` writes each stage's rows
below the shared folder and rereads them, so that no stage computes its predecessors again and a lost executor costs
only its own tasks; a stage's folder is removed once the next stage is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlens.llm.common import remove_path, scratch_path
from chainlens.llm.language_id import UNKNOWN, identify, learn_profiles, with_letters
from chainlens.llm.line_dedup import dedup_lines
from chainlens.llm.mixing import mixed_documents
from chainlens.llm.near_dups import near_duplicates, told_apart
from chainlens.llm.packing import pack
from chainlens.session import materialize

NEAR_PERCENT = 80


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns renamed c0, c1, ..., so that no operator's own column can meet them, and the new name of each."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(found: DataFrame, names: dict[str, str]) -> DataFrame:
    """The input's columns under their own names."""
    return found.select(*[F.col(new).alias(old) for old, new in names.items()])


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter or a text go, and no others.

    Where no profile can be learned (no label, or no letter in the labelled texts) no language can be told apart: all texts with
    a letter stay. Repeated rows stay; every column passes unchanged, whatever its name.
    """
    profiles = materialize(learn_profiles(docs.select(F.col("doc_id").alias("id"), "lang", "text")))
    plain, names = _plain(docs)
    if profiles.isEmpty():
        return _restored(with_letters(plain, names["text"]), names)
    return _restored(identify(plain, profiles, names["text"]).where(F.col("lang_pred") != UNKNOWN), names)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 10 characters stay in the smallest document only; n_chars, where there is one, follows the text.

    Rows that repeat a doc_id are one document; a null doc_id is the last one. Other columns pass unchanged.
    """
    plain, names = _plain(docs)
    kept = dedup_lines(plain, names["doc_id"], names["text"])
    if "n_chars" in names:
        size = names["n_chars"]
        length = F.char_length(names["text"]).cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn(size, F.when(F.col("n_dropped") > 0, length).otherwise(F.col(size)))
    return _restored(kept, names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, the one with the smallest doc_id.

    Rows equal in doc_id and text are copies, whatever their texts. Other rows that share a doc_id, or have none, are
    documents of their own, behind all others. Texts without a word are never near-duplicates of another row.
    """
    plain, names = _plain(docs)
    told = told_apart(plain, names["doc_id"], names["text"], "own_id")
    found = near_duplicates(told, "own_id", names["text"], percent=NEAR_PERCENT)
    gone = found.where("id <> component").select(F.col("id").alias("own_id"))
    return _restored(told.join(gone, "own_id", "left_anti"), names)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with every column unchanged."""
    plain, names = _plain(docs)
    return _restored(mixed_documents(plain, id_col=names["doc_id"], text_col=names["text"], source_col=names["source"]), names)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids, with the ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, remember=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack_sequences),
]

# SQL cannot run a tokenizer; tests compare the stages with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
