"""Problem 3: records that differ only in formatting, collapsed by dictionary encoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.lookalike import bare_sql, form_sql, run_sql
from deskloom.runtime import cut

#: A labelled field: at the start or after a separator one to three words, then ``:``, ``=`` or a spaced dash.
LABEL = re.compile(r"(?:^[\s\"'“”(\[]*|[\n/|,;][ \t]*)([^\W\d_]+(?: [^\W\d_]+){0,2})[ \t]*(?:[:=]|[-–—](?=\s))\s*")
LEAST_FIELDS = 2
_RE2_HINT = r"[:=]|\s[-–—]\s"


def fields_of(text: str) -> list[tuple[str, str]] | None:
    """Label and value of each field, or None where ``text`` is no labelled form.

    A form begins with a label and has at least two different ones: a single field has no order.
    """
    found = list(LABEL.finditer(text))
    if len(found) < LEAST_FIELDS or found[0].start() or len({m[1].lower() for m in found}) < LEAST_FIELDS:
        return None
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(m[1], text[m.end() : end]) for m, end in zip(found, ends)]


def _squeeze_sql(x: str) -> str:
    return f"replace({bare_sql(x)}, ' ', '')"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Field values of each record as digests of their canonical values; each distinct value of a batch is canonicalised once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("text").dictionary_encode()
        shown = run_sql(pa.table({"x": column.dictionary}), f"SELECT y, regexp_matches(y, '{_RE2_HINT}') AS hint, {_squeeze_sql('y')} AS bare FROM (SELECT {form_sql('x')} AS y FROM batch)").to_pydict()
        codes: dict[str, int] = {}  # this batch's dictionary of raw field values
        split: list[list[tuple[str, int]] | None] = []
        for y, hint, bare in zip(shown["y"], shown["hint"], shown["bare"]):
            fields = fields_of(y) if hint else None
            if fields:
                split.append([(label, codes.setdefault(value, len(codes))) for label, value in fields])
            else:
                split.append(None)
        values = run_sql(pa.table({"x": pa.array(list(codes), pa.string())}), f"SELECT {_squeeze_sql('x')} AS v FROM batch").column("v").to_pylist() if codes else []
        digest = lambda s: hashlib.md5(s.encode()).digest()
        entries: list[list[bytes] | None] = []
        for fields, bare in zip(split, shown["bare"]):
            if fields:
                entries.append([digest(label.lower() + "\0" + values[code]) for label, code in fields])
            else:
                entries.append([digest(bare)] if bare else None)
        out = [None if i is None else entries[i] for i in column.indices.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.list_(pa.binary()))], ["k", "entries"])


def value_digests(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """``k, entries``: each key's field values as 128-bit digests, in the order written."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where("k IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(_encode, "k string, entries array<binary>").where("entries IS NOT NULL")


def formatting_groups(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """One row per key: ``episode_id, first_id, copies``.

    Records that are the same apart from blanks, letter case, punctuation,
    the order of labelled fields and invisible differences share ``first_id``,
    the smallest key among them; ``copies`` counts their different keys.
    Distinct canonical values get integers from a global dictionary; a record
    becomes the sorted tuple of its integers, and tuples are grouped. A text
    without labels is one value. Null keys, null texts and texts with nothing
    but blanks and punctuation have no row; a key delivered again counts once.
    """
    records = cut(value_digests(df, key=key, text=text).distinct().withColumn("record", F.monotonically_increasing_id()))
    single = records.where(F.size("entries") == 1).select("record", "k", F.col("entries")[0].alias("entry"))
    several = records.where(F.size("entries") > 1).select("record", "k", F.explode("entries").alias("entry"))
    distinct = single.select("entry").union(several.select("entry")).distinct()
    dictionary = cut(distinct.select("entry", F.monotonically_increasing_id().alias("code")))
    one = single.join(dictionary, "entry").select("k", F.array("code").alias("codes"))
    many = several.join(dictionary, "entry").groupBy("record", "k").agg(F.array_sort(F.collect_list("code")).alias("codes"))
    tuples = cut(one.union(many.select("k", "codes")).distinct())
    groups = tuples.groupBy("codes").agg(F.min("k").alias("first_id"), F.count("*").alias("copies"))
    return tuples.join(groups, "codes").select(F.col("k").alias("episode_id"), "first_id", "copies")
