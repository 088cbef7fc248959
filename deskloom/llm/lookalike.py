"""Problem 1: one consistent form for text that looks the same on screen.

The normaliser is DuckDB SQL run inside Arrow partitions, so one batch costs one
vectorised query and no per-row Python. The same expressions serve the oracle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskloom.runtime import cut

# --- fixed values -----------------------------------------------------------
#: Letters of other scripts that are drawn like a Latin letter.
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ӏ": "I", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
}
GREEK = {
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
OTHER = {"ɡ": "g", "ɑ": "a", "օ": "o", "ո": "n", "ս": "u", "հ": "h"}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}
#: Characters without a width of their own, as an RE2 class.
INVISIBLE = (
    r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}"
)
# ---------------------------------------------------------------------------
#: Stand-ins while invisible characters are stripped; no text may contain noncharacters.
_JOIN, _STYLE = "﷑", "﷒"


def _compatible() -> dict[str, str]:
    """Width forms, letters of mathematics and kinds of blank, by rule from the Unicode decompositions."""
    found = {}
    for code in [*range(0x80, 0x3100), *range(0xFF00, 0xFFF0), *range(0x1D400, 0x1D800)]:
        kind, _, rest = unicodedata.decomposition(chr(code)).partition("> ")
        if kind in ("<wide", "<narrow", "<font") and " " not in rest:
            found[chr(code)] = chr(int(rest, 16))
        elif unicodedata.category(chr(code)) == "Zs" and code != 0x1680:
            found[chr(code)] = " "
    return found


def _with_accents(letters: dict[str, str]) -> dict[str, str]:
    """``letters`` and, by rule, the accented ones that decompose into them."""
    found = dict(letters)
    for code in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:
        base, *marks = unicodedata.normalize("NFD", chr(code))
        latin = unicodedata.normalize("NFC", letters[base] + "".join(marks)) if marks and base in letters else ""
        if len(latin) == 1:
            found[chr(code)] = latin
    return found


CYRILLIC, GREEK = _with_accents(CYRILLIC), _with_accents(GREEK)
_STYLED = {k: v for k, v in _compatible().items() if ord(k) > 0x1D000}
_MAP = {**{k: v for k, v in _compatible().items() if k not in _STYLED}, **CYRILLIC, **GREEK, **OTHER}
_FROM, _TO = "".join(_MAP), "".join(_MAP.values())
#: Latin letters that no letter of the other script resembles; a word that has one stays Latin.
_BACK = {}
for _name, _table in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
    _pairs: dict[str, str] = {}
    for _other, _latin in _table.items():
        _pairs.setdefault(_latin, _other)
    _BACK[_name] = ("".join(_pairs), "".join(_pairs.values()))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def form_sql(x: str) -> str:
    """SQL for the form of the string expression ``x``; NULL stays NULL.

    Steps: replace letters of mathematics; compose accents; protect joiners inside emoji; drop invisible
    characters; map width forms, blanks and look-alikes; spell out ligatures;
    compose again. Words that keep a letter of another script are given back
    to that script as a whole, so real Greek or Cyrillic stays readable.
    Case, punctuation, accents, digits, tabs, line breaks and the number of
    blanks are left alone.
    """
    # letters of mathematics are seldom, and what they stand for may be a look-alike in turn
    styled = f"CASE WHEN regexp_matches({x}, '[\\x{{1D400}}-\\x{{1D7FF}}]') THEN translate({x}, {_lit(''.join(_STYLED))}, {_lit(''.join(_STYLED.values()))}) ELSE {x} END"
    s = f"nfc_normalize({styled})"
    joined = f"regexp_replace({s}, '([\\p{{So}}\\x{{FE0F}}\\x{{1F3FB}}-\\x{{1F3FF}}])\\x{{200D}}', '\\1{_JOIN}', 'g')"
    joined = f"regexp_replace({joined}, '{_JOIN}([^\\p{{So}}]|$)', '\\1', 'g')"
    joined = f"regexp_replace({joined}, '(\\p{{So}})\\x{{FE0F}}', '\\1{_STYLE}', 'g')"
    bare = f"regexp_replace({joined}, '[{INVISIBLE}]', '', 'g')"
    s = f"CASE WHEN regexp_matches({s}, '[\\x{{200D}}\\x{{FE0F}}]') THEN replace(replace({bare}, '{_JOIN}', chr(8205)), '{_STYLE}', chr(65039)) ELSE regexp_replace({s}, '[{INVISIBLE}]', '', 'g') END"
    s = f"translate({s}, {_lit(_FROM)}, {_lit(_TO)})"
    spelled = s
    for one, many in LIGATURES.items():
        spelled = f"replace({spelled}, '{one}', '{many}')"
    # ASCII is its own form
    return f"CASE WHEN regexp_matches({x}, '[^\\x01-\\x7F]') THEN nfc_normalize({spelled}) ELSE {x} END"


def own_script_sql(x: str) -> str:
    """SQL that gives words of ``x`` (a mapped text) back to the script of their unmistakable letters."""
    word = "w"
    cases = ""
    for name, (latin, other) in _BACK.items():
        only = "[A-Za-z]"
        cases += f" WHEN regexp_matches({word}, '\\p{{{name}}}') AND NOT regexp_matches(translate({word}, {_lit(latin)}, {_lit('' )}), '{only}') THEN translate({word}, {_lit(latin)}, {_lit(other)})"
    whole = f"array_to_string(list_transform(string_split({x}, ' '), lambda {word}: CASE{cases} ELSE {word} END), ' ')"
    return f"CASE WHEN regexp_matches({x}, '[\\p{{Cyrillic}}\\p{{Greek}}]') THEN {whole} ELSE {x} END"


def bare_sql(form: str) -> str:
    """SQL for words of ``form`` in one case without punctuation, separated by single blanks."""
    s = f"replace(replace(lower({form}), 'ß', 'ss'), 'ẞ', 'ss')"
    s = f"regexp_replace({s}, '[\\p{{P}}|=~^`]', '', 'g')"
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


_connection = None


def duck():
    """This worker's DuckDB, one thread and bounded memory."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(":memory:")
        _connection.execute("SET threads=1; SET memory_limit='400MB'; SET preserve_insertion_order=true")
    return _connection


#: Bytes that one query sees at a time; a batch of long texts is taken in parts.
PART_BYTES = 16 << 20


def run_sql(batch: pa.RecordBatch | pa.Table, sql: str) -> pa.Table:
    """``sql`` over ``batch``, named ``batch`` in it; keeps the order of rows.

    What it says of a row must not depend on others, or be summed up later: large batches are taken in parts.
    """
    if batch.num_rows > 1 and batch.nbytes > PART_BYTES:
        half = batch.num_rows // 2
        return pa.concat_tables([run_sql(batch.slice(0, half), sql), run_sql(batch.slice(half), sql)])
    con = duck()
    con.register("batch", pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("batch")


def map_sql(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """Run ``sql`` over each Arrow batch of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from run_sql(batch, sql).cast(kind).to_batches()

    return df.mapInArrow(each, schema)


def consistent_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace each of ``columns`` by its one consistent form.

    Other columns pass through unchanged; nulls stay null, an empty text stays
    empty, and repeated rows stay repeated.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    inner, outer = [], []
    for name in df.columns:
        q = '"' + name.replace('"', '""') + '"'
        inner.append(f"{form_sql(q)} AS {q}" if name in columns else q)
        outer.append(f"{own_script_sql(q)} AS {q}" if name in columns else q)
    return map_sql(df, f"SELECT {', '.join(outer)} FROM (SELECT {', '.join(inner)} FROM batch)", schema)


def _looks(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``k, field_name, form, raw``: each key's different values as 128-bit digests of their form and of themselves; nulls and blanks leave."""
    parts = []
    for name in fields:
        q = f'"{name}"'
        parts.append(f"SELECT k, '{name}' AS field_name, unhex(md5(y)) AS form, unhex(md5(x)) AS raw FROM (SELECT k, {q} AS x, {form_sql(q)} AS y FROM batch) WHERE regexp_matches(y, '\\S')")
    digests = map_sql(df.select(F.col(key).alias("k"), *fields).where(F.col("k").isNotNull()), " UNION ALL ".join(parts), "k string, field_name string, form binary, raw binary")
    return cut(digests.dropDuplicates())


def same_looking_classes(df: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """``episode_id, field_name, first_id, members, spellings``: each key's class of values that look the same.

    ``first_id`` is the smallest key of the class, ``members`` its different
    keys and ``spellings`` its different strings; a class of a third of all
    rows costs a row for each member. A key given several texts that look
    different is in a class for each. Null keys, null and blank texts have no row.
    """
    rows = _looks(df, key, fields)
    own = ["field_name", "form"]
    keys = rows.select("k", *own).distinct()
    spellings = rows.select("raw", *own).distinct().groupBy(*own).agg(F.count("*").alias("spellings"))
    classes = keys.groupBy(*own).agg(F.min("k").alias("first_id"), F.count("*").alias("members")).join(spellings, own)
    return keys.join(classes, own).select(F.col("k").alias("episode_id"), "field_name", "first_id", "members", "spellings")


def same_looking_pairs(df: DataFrame, *, key: str, fields: list[str]) -> DataFrame:
    """Pairs of different ``key`` whose ``fields`` look the same but are different strings: the classes of that name, spelled out.

    Columns ``episode_a, episode_b, field_name``, smaller key first. Only
    128-bit digests of forms and raw strings are shuffled. Forms with a single
    spelling leave before the join, so exact copies never meet each other.
    Rows with a null key, null or blank text make no pair; a key given several
    times counts once for each different text.
    """
    rows = _looks(df, key, fields)
    several = rows.groupBy("field_name", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("field_name", "form")
    some = rows.join(several, ["field_name", "form"], "left_semi")
    a, b = some.alias("a"), some.alias("b")
    on: Column = (F.col("a.form") == F.col("b.form")) & (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.raw") != F.col("b.raw"))
    return a.join(b, on).select(F.col("a.k").alias("episode_a"), F.col("b.k").alias("episode_b"), F.col("a.field_name").alias("field_name")).distinct()
