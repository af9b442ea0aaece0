"""Operators as filters over documents, for pipelines: each gives the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lang_ppm, sp_codec
from .common import columns_only, stored
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .near_dedup import near_duplicates

DOCUMENTS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def documents(docs: DataFrame) -> DataFrame:
    return columns_only(docs, **DOCUMENTS)


def with_language(docs: DataFrame) -> DataFrame:
    """Documents with a predicted language.

    A null, empty or letterless text has none, and goes, whatever was learned. With no labelled rows to learn from no language
    can be refused, so every text with a letter stays. Null ids and repeated rows are kept as they are; an empty table gives an
    empty one; columns other than those of documents are left out.
    """
    docs = documents(docs)
    model = lang_ppm.fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = lang_ppm.identify(docs, model, keep=tuple(c for c in DOCUMENTS if c != "doc_id"))
    return documents(found.filter(F.col("lang_pred") != lang_ppm.UNKNOWN))


def without_copies(docs: DataFrame) -> DataFrame:
    """Of equal texts (white space apart) the one that exact_dedup keeps.

    Null and empty texts are equal to each other, so one of them stays; of rows that share id and text one stays; rows with a
    null id are rows like any other; an empty table gives an empty one.
    """
    rest = tuple(c for c in DOCUMENTS if c not in ("doc_id", "text"))
    return documents(exact_dedup(documents(docs), keep=rest).filter("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id.

    Texts without words, and null ones, are alone in their group and stay; rows with a null id stay; rows that share an id are
    one document, so they stay or go together; an empty table gives an empty one.
    """
    docs = documents(docs)
    kept = near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("k_id"))
    return docs.join(kept.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(kept["k_id"]), "left_semi")


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents in which no window of any benchmark item occurs: one item is enough for a document to go.

    Each row has its own verdict, by a stored row key, as ids can be null or repeated. A null text and one without words stay
    (they hold no window); items without an id or without words match nothing; repeated rows have the same verdict; with an
    empty benchmark all documents stay; an empty table gives an empty one.
    """
    keyed, _ = stored(documents(docs).withColumn("row_key", F.monotonically_increasing_id()), "keyed")
    found = decontaminate(keyed, items, id_col="row_key", min_items=1, slop=0).filter("contaminated").select(F.col("doc_id").alias("row_key"))
    return documents(keyed.join(found.hint("shuffle_hash"), "row_key", "left_anti"))


def as_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """SentencePiece ids of every document, in place of its text.

    Null and empty texts have an empty list; null ids and repeated rows are kept; an empty table gives an empty one.
    """
    return sp_codec.encode(documents(docs), model_path, keep=("lang", "source", "n_chars"))
