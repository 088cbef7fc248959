"""TF-IDF in long form and exact cosine search over it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.functions.text import analyze
from deskloom.operators import search

OVERFETCH = 8


def terms_of(docs: DataFrame, *, doc: str, terms: Column) -> DataFrame:
    """``doc, term, tf`` of every document."""
    return docs.select(F.col(doc).alias("doc"), F.explode(terms).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def line(words: Column) -> Column:
    """Words joined by blanks, half the size of their terms."""
    return F.array_join(words, " ")


def documents(rows: DataFrame, *, doc: str, line: str = "line") -> DataFrame:
    """``doc, lines``: the lines of every document that have words."""
    return rows.where(F.col(line) != "").groupBy(F.col(doc).alias("doc")).agg(F.collect_list(line).alias("lines"))


def line_terms(docs: DataFrame) -> DataFrame:
    """``term`` once for every document that holds it, from ``doc, lines``."""
    terms = F.flatten(F.transform("lines", lambda x: analyze(F.split(x, " "))))
    return docs.select(F.explode(F.array_distinct(terms)).alias("term"))


def weigh(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc, terms, weights`` of ``doc, lines``: :func:`transform` without a row for each term.

    ``vocabulary`` has a cap, so workers get it whole; ``terms`` are places in it.
    """
    known = vocabulary.select("term", "idf").toArrow().combine_chunks()  # at most max_features rows
    names, idf = known.column("term").combine_chunks(), known.column("idf").to_numpy().astype(float)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column("lines")
            doc_of_line = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
            split = pc.split_pattern(pc.list_flatten(lines), " ")
            line = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
            words = pc.list_flatten(split)
            near = np.flatnonzero(line[1:] == line[:-1])
            pairs = pc.binary_join_element_wise(words.take(pa.array(near)), words.take(pa.array(near + 1)), "_")
            ids = np.concatenate([pc.fill_null(pc.index_in(x, value_set=names), -1).to_numpy(zero_copy_only=False) for x in (words, pairs)]).astype(np.int64)
            of = doc_of_line[np.concatenate([line, line[near]])]
            cells, tf = np.unique(of[ids >= 0] * max(1, len(idf)) + ids[ids >= 0], return_counts=True)
            doc, term = cells // max(1, len(idf)), cells % max(1, len(idf))
            x = (1 + np.log(tf)) * idf[term]
            norm = np.sqrt(np.bincount(doc, x * x, minlength=batch.num_rows))
            held = np.flatnonzero(norm > 0)
            w = x.astype(np.float32) * (1 / norm[doc]).astype(np.float32)
            offsets = pa.array(np.concatenate([np.searchsorted(doc, held), [len(doc)]]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(held)), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(w, pa.float32()))], ["doc", "terms", "weights"])

    return docs.select(F.col("doc").cast("string").alias("doc"), "lines").mapInArrow(each, "doc string, terms array<int>, weights array<float>")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def fit(counts: DataFrame, n_docs: int | DataFrame, *, min_df: int = 1, max_features: int = 0) -> DataFrame:
    """``term, df, idf``: terms in at least ``min_df`` documents, the ``max_features`` most frequent of them (0: all).

    idf is ``ln((1 + n) / (1 + df)) + 1`` in single precision.
    """
    vocabulary = document_frequency(counts).where(F.col("df") >= min_df)
    if max_features > 0:
        vocabulary = vocabulary.orderBy(F.desc("df"), "term").limit(max_features)
    if isinstance(n_docs, DataFrame):
        vocabulary, n = vocabulary.crossJoin(F.broadcast(n_docs.agg(F.count("*").alias("n")))), F.col("n")
    else:
        n = F.lit(n_docs)
    return vocabulary.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).cast("float").alias("idf"))


def vocabulary_ids(vocabulary: DataFrame) -> DataFrame:
    """``term, df, idf, term_id`` with ids from 0 in order of terms; for vocabularies that a cap keeps small."""
    return vocabulary.withColumn("term_id", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


def transform(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``doc, term, w``: ``(1 + ln tf) * idf``, scaled to length 1 per document, in single precision.

    Terms outside the vocabulary drop out; a document without known terms has no row.
    """
    raw = counts.join(vocabulary.select("term", "idf"), "term").select("doc", "term", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("x").cast("float") * (1 / norm).cast("float")).cast("float").alias("w"))


def top_score(queries: DataFrame, ids: DataFrame, index: DataFrame) -> DataFrame:
    """``q, top_score`` for every ``doc`` of ``ids``; 0 where nothing is similar. Both sides are ``doc, term, w`` or ``doc, terms, weights``."""
    best = search.top_k(search.vectors(queries), search.vectors(index), 1).select("q", "score")
    return ids.select(F.col("doc").cast("string").alias("q")).join(best, "q", "left").select("q", F.coalesce("score", F.lit(0.0)).alias("top_score"))


def precedents(queries: DataFrame, index: DataFrame, signatures: DataFrame, k: int) -> DataFrame:
    """``q, doc, score, rank``: among the best ``8 k`` documents, the best of each reply signature, then the first ``k``."""
    near = search.top_k(search.vectors(queries), search.vectors(index), OVERFETCH * k).join(signatures, "doc")
    twins = Window.partitionBy("q", "signature").orderBy("rank")
    one = near.withColumn("twin", F.row_number().over(twins)).where("twin = 1")
    order = Window.partitionBy("q").orderBy("rank")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("q", "doc", "score", F.col("place").alias("rank"))


def dense_terms(df: DataFrame, *, doc: str, vector: str) -> DataFrame:
    """Dense vectors as ``doc, term, w`` of length 1; zero vectors have no row."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = df.select(F.col(doc).alias("doc"), F.posexplode(vector).alias("term", "x"), length.alias("len")).where("len > 0")
    return rows.select("doc", "term", (F.col("x") / F.col("len")).alias("w"))
