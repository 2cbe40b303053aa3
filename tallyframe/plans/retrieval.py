"""Documents for retrieval: chunks, embeddings, the chunks nearest to a question, and an answer made from them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.texts import CHUNK, OVERLAP, chunks
from ..operators.vectors import similar_to_few
from ..sources.store import TableStore
from ..sources.tables import table
from .registry import Registry

R = Registry()
#: Length of the vectors of the hashing embedder.
DIMENSION = 256
#: What is answered when nothing is stored.
NOTHING = "No documents have been added yet."


def hashed(text: Column, dimension: int = DIMENSION) -> Column:
    """A text's vector: how often the words that hash to each place occur, with a sign that is part of the hash. No text, no direction.

    Built from Arrow batches: counting hashed places has no built-in expression.
    """

    def vectors(texts: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        out, known = [], {}
        for t in texts:
            words = re.findall(r"\w+", (t or "").lower())
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            h = np.array([known[w] for w in words], dtype=np.uint64)
            sign = np.where(h >> np.uint64(63), 1.0, -1.0)
            out.append(np.bincount((h % np.uint64(dimension)).astype(np.int64), weights=sign, minlength=dimension))
        return pd.Series(out)

    return F.pandas_udf(vectors, "array<double>")(text)


def embedded(docs: DataFrame, doc_id: str, text: str, embed: Callable[[Column], Column] = hashed, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, doc_id, chunk_no, chunk and embedding of every chunk of the documents. `embed` maps a text column to a vector column."""
    c = chunks(docs, doc_id, text, size, overlap)
    name = F.concat_ws("#", F.col(doc_id).cast("string"), F.col("chunk_no").cast("string"))
    return c.select(name.alias("chunk_id"), F.col(doc_id).alias("doc_id"), "chunk_no", "chunk", embed(F.col("chunk")).alias("embedding"))


def add_documents(store: TableStore, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", embed: Callable[[Column], Column] = hashed, name: str = "chunks") -> None:
    """Store the chunks of documents; those of a document that was stored before are replaced."""
    new = embedded(docs, doc_id, text, embed)
    if store.exists(name):
        new = store.read(name).join(docs.select(F.col(doc_id).alias("doc_id")).distinct(), "doc_id", "left_anti").unionByName(new)
    store.write(name, new)


def clear_documents(store: TableStore, name: str = "chunks") -> None:
    """Remove all stored chunks."""
    if store.exists(name):
        store.write(name, store.read(name).limit(0))


def retrieve(stored: DataFrame, questions: DataFrame, question_id: str, question: str, top: int = 5, embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """query_id, row_id (the chunk's) and similarity of the `top` chunks nearest to each question."""
    q = questions.select(F.col(question_id).alias("__q"), embed(F.col(question)).alias("embedding"))
    return similar_to_few(stored.select("chunk_id", "embedding"), q, "chunk_id", "__q", "embedding", top)


def answer(spark: SparkSession, stored: DataFrame, question: str, respond: Callable[[str, Sequence[str]], str], top: int = 5, embed: Callable[[Column], Column] = hashed) -> str:
    """What `respond` says to a question and its nearest chunks; a fixed message when nothing is stored, and an error as text."""
    if stored.isEmpty():
        return NOTHING
    asked = spark.createDataFrame([(0, question)], "id int, question string")
    found = retrieve(stored, asked, "id", "question", top, embed).join(stored.select(F.col("chunk_id").alias("row_id"), "chunk"), "row_id")
    try:
        return respond(question, [r.chunk for r in found.orderBy(F.desc("similarity"), "row_id").collect()])  # at most `top` rows
    except Exception as e:  # the answer of a failing responder is its error
        return f"Error: {e}"


@R.add()
def retrieved_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The 3 chunks nearest to each evaluation question whose id is divisible by 20, by the hashing embedder."""
    stored = embedded(table(spark, root, "documents"), "doc_id", "text")
    return retrieve(stored, table(spark, root, "eval_items").where("item_id % 20 = 0"), "item_id", "question", 3)
