"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the columns of documents; the
last returns tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as _row: what a stage adds can't clash with any column of docs."""
    more = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(more or [F.lit(0).alias("_")])).alias("_row"))


def _unpacked(rows: DataFrame, docs: DataFrame, changed: dict | None = None) -> DataFrame:
    """The columns of docs, some of them changed."""
    changed = {"doc_id": F.col("doc_id"), "text": F.col("text")} | (changed or {})
    return rows.select(*((changed[c] if c in changed else F.col("_row")[c]).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't call toxic.

    Null and empty texts get the score of no words; repeated rows fare alike. Without labels of both classes nothing is
    called toxic unless most labels are. Columns of docs stay, whatever their names. No documents give none.
    """
    from strandloom.llm.toxicity import fit_toxicity, score_toxicity

    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(score_toxicity(_packed(docs), model).where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that later occurrences of a three-line window cover; n_chars follows the text.

    Null texts stay null, and a text may end empty. Rows equal in id and text count as one and keep the same lines.
    Columns of docs stay, whatever their names. No documents give none.
    """
    from strandloom.llm.line_dedup import dedup_lines

    rows = dedup_lines(_packed(docs))
    return _unpacked(rows, docs, {"n_chars": F.length("text").cast("long")})


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of texts linked at a Jaccard coefficient of 0.8 or more.

    Texts without words, null ones too, are no copies and stay; of rows equal in id and text one stays. Columns of docs
    stay, whatever their names. No documents give none.
    """
    from strandloom.llm.jaccard_join import keep_one

    return _unpacked(keep_one(_packed(docs)), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which tiles cover less than 0.8 of every benchmark item.

    Null and empty texts, and all where the benchmark is empty, stay; repeated rows fare alike. Columns of docs stay,
    whatever their names. No documents give none.
    """
    from strandloom.llm.decontaminate import find_leaks

    return _unpacked(find_leaks(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens, and whether the tokens decode to the text; a null text counts as empty, which has no tokens. A row for each row of docs."""
    import public_tokenizers

    from strandloom.llm.sentence_pieces import decode_pieces, encode_pieces

    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = decode_pieces(encode_pieces(docs, model), model)
    return rows.select("doc_id", "token_ids", F.size("token_ids").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL can't express a trained classifier or a Viterbi search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written to the shared folder before the next."""
    from strandloom.llm.common import stash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
    return docs
