"""Problem 10: texts cut off by a field limit or on the way.

The vocabulary of the whole corpus is kept as a trie (every prefix with the uses of
the words below it). A text is suspicious where its last token is unknown and a
proper prefix of known words, or a known word that hardly ever ends a sentence in
its context; lengths at which texts of its source pile up weigh in. Everything is
added as log-odds.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.llm.tokens import clean_source
from deskloom.runtime import cut

#: Log-odds: of a cut before anything is known, with dots, with a cut mark, after a finished sentence.
PRIOR, DOTS, MARK, FINISHED = -2.0, 2.5, 8.0, -6.0
PREFIX_BONUS, UNSEEN_BONUS, LENGTH_CAP = 4.5, 1.0, 5.0
#: A token is unknown below so many uses inside texts, or below this share of the uses of the words it begins.
KNOWN_USES, RARE_SHARE = 3, 0.003

_MARK = re.compile(r"(?:[\[<({]\s*(?:[\w ]{1,20} )?(?:truncated|cut|cut off|snip|more|continued|trimmed|clipped|part \d+[^\])]*|\.\.\.|…)\s*[\])>}]|[\[<({]\s*\w[^\])}>]{0,40}|&#?\w{0,7}|&|�+|[\ud800-\udfff])\s*$", re.I)
_LINK = re.compile(r"\s*https?://\S*$")
_TRAILER = re.compile(r"\s*(?:[\[<({][^\])}>\[<({]{1,40}[\])}>]|#[^\W_]\w*|\*[A-Z]{2}|[:;]-?[()DP]|[^\w\s.,;:!?…\"'’)\]}&<>\-/$€%]+)$")
_EDGE_L, _EDGE_R = "\"'“”‘’(¿¡[<", "\"'“”’)]>,;:"


def shape(token: str) -> str:
    """A token for counting: lower case; codes as as many x, other digits as runs of 9."""
    t = token.strip(_EDGE_L + _EDGE_R)
    if t.startswith("http"):
        host, _, path = t.partition("://")[2].partition("/")
        return "//" + host.lower() + ("/" + "x" * len(path) if "/" in t[8:] else "")
    if re.fullmatch(r"[A-Z]{2}\d{0,4}", t):
        return "FL" + "9" * (len(t) - 2)
    if not any(c.isdigit() for c in t):
        return t.lower()
    if re.fullmatch(r"[A-Z]{1,3}-[\d-]+", t):
        return re.sub(r"\d", "9", t.lower())
    if len(t) >= 5 and re.fullmatch(r"[A-Z0-9]+", t):
        return "x" * len(t)
    if re.fullmatch(r"\d{4,}", t):
        return "9" * len(t)
    return re.sub(r"\d+", "9", t.lower())


_SHAPES: dict[str, str] = {}
_TOKENS: dict[str, tuple[str, int, str]] = {}
#: Places in counts: inside a sentence, at its end, before dots, at the end of a text.
_AT = {"": 0, ".": 1, "…": 2}


def _shape(token: str) -> str:
    s = _SHAPES.get(token)
    if s is None:
        if len(_SHAPES) > 200_000:
            _SHAPES.clear()
        s = _SHAPES[token] = shape(token)
    return s


def _look(token: str) -> tuple[str, int, str]:
    """Shape, place and class of a token inside a text, remembered for tokens to come."""
    core, closing = _core(token)
    if len(_TOKENS) > 200_000:
        _TOKENS.clear()
    found = _TOKENS[token] = (_shape(core), _AT[closing], _class(core))
    return found


def _class(core: str) -> str:
    """Like the shape, with one class for capitalised words."""
    return "Aa" if core[:1].isupper() and core[1:].islower() and core.isalpha() else _shape(core)


def _core(token: str) -> tuple[str, str]:
    """A token without what closes it, and the class of that: "." a sentence's end, "…" dots, "" nothing."""
    t = token.rstrip(_EDGE_R)
    if t.endswith("...") or t.endswith("…"):
        return t.rstrip(".…"), "…"
    u = t.rstrip(".!?")
    return (u, ".") if u != t else (t, "")


def ending(text: str) -> dict:
    """How a text ends: mark, closing class and its last tokens behind links, tags and signs."""
    t = text.rstrip()
    mark = False
    if m := _MARK.search(t):
        mark = bool(m[0].strip())
        t = t[: m.start()].rstrip()
    link = ""
    if m := _LINK.search(t):
        link, t = _shape(m[0].strip()), t[: m.start()]
    while (m := _TRAILER.search(t)) and m.end() > m.start():
        t = t[: m.start()]
    tokens = t.rsplit(None, 4)[-4:]
    if not tokens:
        return {"mark": mark, "closing": "", "one": None, "two": None, "four": None, "link": link or None}
    last, closing = _core(tokens[-1])
    one = _shape(last)
    before, classes = "^", [_class(last)]
    for i, token in enumerate(reversed(tokens[:-1])):
        core, end = _core(token)
        if end == ".":
            break
        if i == 0:
            before = _shape(core)
        classes.insert(0, _class(core))
    two, four = f"{before} {one}", " ".join(["^"] * (4 - len(classes)) + classes)
    return {"mark": mark, "closing": closing, "one": one or None, "two": two if one else None, "four": four if one else None, "link": link or None}


_OUT = "kind string, doc_id long, source string, n long, b long, mark boolean, closing string, one string, two string, four string, link string, medial long, final long, dotted long, ending long"
_COLUMNS = [x.split()[0] for x in _OUT.split(", ")]
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 5, *[pa.int64()] * 4]


def _counted(*parts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of equally long columns of whole numbers, and how often each occurs."""
    key = np.zeros(len(parts[0]), np.int64)
    for part in parts:
        wide = int(part.max()) + 1 if len(part) else 1
        if len(key) and int(key.max()) > (1 << 62) // wide:
            key = np.unique(key, return_inverse=True)[1]
        key = key * wide + part
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [part[first] for part in parts], n


def token_counts(texts: list[str]) -> dict[str, dict[str, list[int]]]:
    """For tokens, pairs and fours of classes inside ``texts``: how often a text goes on, a sentence ends, or dots follow.

    Distinct tokens are looked at once; what surrounds them is found for all places at a time.
    """
    lists = [text.split()[:-1] for text in texts]
    flat = pa.array(itertools.chain.from_iterable(lists), pa.string()).dictionary_encode()
    names, kinds = {"^": 0}, {"^": 0}
    looked = [_TOKENS.get(t) or _look(t) for t in flat.dictionary.to_pylist()]
    one = np.array([names.setdefault(x, len(names)) if x else -1 for x, _, _ in looked], np.int64)
    at, kind = np.array([x for _, x, _ in looked], np.int64), np.array([kinds.setdefault(x, len(kinds)) for _, _, x in looked], np.int64)
    codes = flat.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    keep = one[codes] >= 0 if len(codes) else np.zeros(0, bool)
    codes, doc = codes[keep], doc[keep]
    one, at, kind = one[codes], at[codes], kind[codes]
    out: dict[str, dict[str, list[int]]] = {"one": {}, "two": {}, "four": {}}
    if not len(codes):
        return out
    starts = np.ones(len(codes), bool)  # of a text or a sentence
    starts[1:] = (doc[1:] != doc[:-1]) | (at[:-1] == 1)
    back = lambda x, n: np.concatenate([np.zeros(n, np.int64), x[:-n]])[: len(x)]
    within = [~starts]
    for n in (1, 2):
        within.append(within[-1] & ~np.concatenate([np.ones(n, bool), starts[:-n]])[: len(starts)])
    spelled, classes = list(names), list(kinds)
    columns = {"one": [one], "two": [np.where(within[0], back(one, 1), 0), one], "four": [*(np.where(within[n - 1], back(kind, n), 0) for n in (3, 2, 1)), kind]}
    for level, parts in columns.items():
        words = classes if level == "four" else spelled
        (*keys, places), n = _counted(*parts, at)
        for key, place, times in zip(zip(*(k.tolist() for k in keys)), places.tolist(), n.tolist()):
            out[level].setdefault(" ".join(words[x] for x in key), [0, 0, 0, 0])[place] += times
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text, and counts of tokens and pairs of tokens by what follows them."""
    for batch in batches:
        rows: list[tuple] = []
        texts = batch.column("text").to_pylist()
        counts = token_counts(texts)
        for doc_id, source, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source")), texts):
            e = ending(text)
            rows.append(("doc", doc_id, source, len(text), len(text.encode("utf8", "surrogatepass")), e["mark"], e["closing"], e["one"], e["two"], e["four"], e["link"], None, None, None, None))
            if e["one"]:
                for level in counts:
                    counts[level].setdefault(e[level], [0, 0, 0, 0])[_AT[e["closing"]] or 3] += 1
            if e["link"]:
                counts["one"].setdefault(e["link"], [0, 0, 0, 0])[3] += 1
        for level, each in counts.items():
            rows += ((level, *[None] * 6, key, *[None] * 3, *n) for key, n in each.items())
        columns = list(zip(*rows)) if rows else [()] * len(_TYPES)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _COLUMNS)


def _pile(docs: DataFrame, size: str) -> DataFrame:
    """``key, pile`` of source and size: log of how much more texts of a source have this size than sizes around it."""
    counts = docs.groupBy("source", size).agg(F.count("*").alias("c"))
    around = Window.partitionBy("source").orderBy(size).rangeBetween(-15, 15)
    usual = (F.sum("c").over(around) - F.col("c") + 1) / 30
    return counts.select(F.concat_ws(" ", "source", size).alias("key"), F.when(F.col("c") >= 4, F.least(F.lit(LENGTH_CAP), F.greatest(F.lit(0.0), F.log(F.col("c") / (usual + 1))))).otherwise(0.0).alias("pile"))


#: Characters of a word up to which each of its prefixes has an entry; longer ones meet the ends of texts that begin alike.
HEAD = 60


def prefix_table(words: DataFrame, ends: DataFrame) -> DataFrame:
    """``one, below``: uses of the words that a token properly begins; ``words`` is ``one, uses``, ``ends`` the tokens ``one`` that texts end with."""
    short = F.transform(F.sequence(F.lit(1), F.least(F.length("one") - 1, F.lit(HEAD))), lambda i: F.substring(F.col("one"), F.lit(1), i))
    entries = words.where(F.length("one") > 1).select(F.explode(short).alias("one"), "uses")
    head = F.substring("one", 1, HEAD).alias("head")
    tails = ends.where(F.length("one") > HEAD).select(head, F.col("one").alias("end")).distinct()
    longer = words.where(F.length("one") > HEAD).select(head, "one", "uses").join(tails, "head").where((F.length("one") > F.length("end")) & F.col("one").startswith(F.col("end")))
    return entries.union(longer.select(F.col("end").alias("one"), "uses")).groupBy("one").agg(F.sum("uses").alias("below"))


def truncation_scores(documents: DataFrame) -> DataFrame:
    """``doc_id, source, truncated, log_odds`` for every document with text.

    Null and blank texts and null ids have no row; rows repeat as often as they
    come. Texts of a null source get no length evidence.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), F.col("text")).where("doc_id IS NOT NULL AND text RLIKE '\\\\S'")
    read = cut(rows.mapInArrow(_read, _OUT))
    docs = read.where("kind = 'doc'").select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "n", "b", "mark", "closing", "one", "two", "four", "link")
    kinds = ("medial", "final", "dotted", "ending")
    counts = cut(read.where("kind <> 'doc'").groupBy("kind", "one").agg(*(F.sum(c).alias(c) for c in kinds)))
    ones = counts.where("kind = 'one'").select("one", *(F.col(c).alias(f"{c}_1") for c in kinds))
    known = F.col("medial_1") + F.col("final_1")
    uses = F.when(F.col("one").startswith("//"), known + F.col("ending_1")).otherwise(known)
    words = ones.where(known + F.col("ending_1") >= KNOWN_USES).select("one", uses.alias("uses"))
    trie = cut(prefix_table(words, ones.where("ending_1 > 0")))
    # one row: how often a word ends a sentence, and how often a text breaks off inside a word, for a word's use;
    # tokens too frequent for cuts of the words they begin are left out of the latter
    broken = ones.where((known < KNOWN_USES) & (F.col("ending_1") > 0)).join(trie, "one").where(F.col("ending_1") <= 0.02 * F.col("below") + 1)
    base = ones.agg(((F.sum("final_1") + 1) / (F.sum(known) + 2)).alias("base"), F.sum(known).alias("all")).crossJoin(broken.agg(F.coalesce(F.sum("ending_1"), F.lit(0)).alias("broken")))
    base = base.select("base", (F.col("broken") / (F.coalesce("all", F.lit(0)) + 1)).alias("cuts"))
    # everything that a document looks up is in one table, so that one join finds it
    none = F.lit(None).cast("double").alias("pile")
    found = counts.join(trie.select(F.lit("one").alias("kind"), "one", "below"), ["kind", "one"], "left").select("kind", F.col("one").alias("key"), *kinds, "below", none)
    links = ones.join(trie, "one").where(F.col("one").startswith("//")).select(F.lit("link"), "one", *(F.col(f"{c}_1") for c in kinds), "below", none)
    zero, sized = [F.lit(0).cast("long")] * 5, docs.where("source IS NOT NULL")
    piles = [_pile(sized, c).select(F.lit(f"pile_{c}"), "key", *zero, "pile") for c in ("n", "b")]
    asked = F.array(*(F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in [*((c, F.col(c)) for c in ("one", "two", "four", "link")), *((f"pile_{c}", F.when(F.col("source").isNotNull(), F.concat_ws(" ", "source", c))) for c in ("n", "b"))]))
    own = ["doc_id", "source", "mark", "closing", "one", "link"]
    keys = docs.select("row", *own, F.explode(F.filter(asked, lambda x: x["key"].isNotNull() | (x["kind"] == "one"))).alias("x")).select("row", *own, "x.kind", "x.key")
    got = keys.join(found.union(links).union(piles[0]).union(piles[1]), ["kind", "key"], "left")
    pick = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    x = got.groupBy("row").agg(
        *(F.first(c).alias(c) for c in own),
        *(pick(kind, c).alias(f"{c}_{mark}") for kind, mark in (("one", 1), ("two", 2), ("four", 4)) for c in kinds),
        pick("one", "below").alias("below"), pick("link", "ending").alias("link_uses"), pick("link", "below").alias("link_below"), pick("pile_n", "pile").alias("pile_n"), pick("pile_b", "pile").alias("pile_b"),
    )
    x = x.crossJoin(F.broadcast(base))  # one row

    all_1, all_2 = F.col("medial_1") + F.col("final_1"), F.col("medial_2") + F.col("final_2")

    def ends(mark: int, prior: Column, weight: float) -> Column:
        """How likely a sentence ends here; ends of texts count beyond what cuts explain."""
        uses = F.col(f"medial_{mark}") + F.col(f"final_{mark}")
        # cuts of longer words that begin like this one end here as well
        beyond = F.greatest(F.lit(0.0), F.col(f"ending_{mark}") - 5 * F.col("cuts") * uses * (1 + F.col("below") / F.greatest(all_1, F.lit(1))) - 1)
        return (F.col(f"final_{mark}") + beyond + weight * prior) / (uses + beyond + weight)

    ends_1 = ends(1, F.col("base"), 1)
    ends_2 = ends(4, ends(2, ends_1, 3), 3)
    # a word that hardly ever ends a sentence, behind a word it never follows, is rather the start of another
    context = F.log(F.col("base") / F.greatest(ends_2, F.lit(1e-4))) + F.when((all_2 == 0) & (ends_1 < 0.02), UNSEEN_BONUS).otherwise(0.0)
    # a token seen only at ends: a sign-off where it is far more frequent than cuts of the words it begins
    fresh = (all_1 < KNOWN_USES) | (all_1 < RARE_SHARE * F.col("below"))
    signoff = fresh & (F.col("ending_1") >= 3) & (F.col("ending_1") > 80 * F.col("cuts") * (F.col("below") + all_1))
    prefix = fresh & (F.col("below") >= KNOWN_USES) & ~signoff
    deliberate = ~prefix & (F.col("dotted_2") >= 3) & (F.col("dotted_2") > 0.5 * (F.col("dotted_2") + all_2 + F.col("ending_2")))
    wording = F.when(F.col("one").isNull(), 0.0).when(prefix, PREFIX_BONUS).when(signoff, -3.0).when(fresh, 0.0).otherwise(context)
    cut_link = F.col("link").isNotNull() & (F.col("link_below") > 2 * F.col("link_uses"))
    length = F.greatest("pile_n", "pile_b")
    odds = (
        F.when(F.col("closing") == ".", F.lit(FINISHED))
        .when((F.col("closing") == "…") & deliberate, F.lit(FINISHED))
        .otherwise(F.lit(PRIOR) + wording + length + F.when(F.col("closing") == "…", DOTS).otherwise(0.0))
        + F.when(F.col("mark"), MARK).otherwise(0.0)
        + F.when(cut_link, MARK).otherwise(0.0)
    )
    return x.select("doc_id", "source", (odds > 0).alias("truncated"), odds.alias("log_odds"))


def source_rates(scores: DataFrame) -> DataFrame:
    """Truncated documents and their rate per source."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("truncated").alias("truncated"), (F.count_if("truncated") / F.count("*")).alias("rate"))
