"""Problem 5: abusive, hateful and sexual content behind disguised spelling.

Noisy channel: a written token is a lattice of the letters it may stand for
(leetspeak, masks, look-alikes, separators, repeated letters). A Viterbi search
finds the best word of the watched vocabulary in that lattice and the best string
under a character model counted over the whole corpus; the watched word is
restored where it explains the token at least as well. Restored texts are scored
by who is attacked and how, so reports, medical words and strong words about
things stay low.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.llm.lookalike import form_sql, run_sql

# --- fixed values -----------------------------------------------------------
INSULTS = """idiot moron imbecile cretin scumbag lowlife asshole arsehole dumbass bastard pig dickhead jackass prick
wanker twat cunt bitch whore slut retard scum dimwit halfwit degenerate parasite vermin trash clown rat loser fool
shithead motherfucker dipshit douchebag filth swine animal maggot subhuman savage""".split()
FOREIGN_INSULTS = "idiota imbécil gilipollas cabrón puta connard connasse salope enculé arschloch wichser hurensohn schlampe missgeburt".split()
EXPLETIVES = """fuck fucking fucked shit shitty crap crappy piss pissed goddamn bloody damn hell bullshit ass stupid
worthless dumb filthy""".split()
SEXUAL = "tits boobs ass nude nudes naked sexy bang screw fuck cock dick pussy underwear lap panties breasts cum horny suck blow undress strip".split()
THREATS = "kill smash rot choke chokes die dead burn hurt punch stab shoot slap murder strangle beat hang".split()
GROUP_WORDS = "parasites vermin thieves filthy animals cage breathe foreigners cockroaches subhuman savages inferior deport rats monkeys apes".split()
AROUSAL = "boner erection orgasm lust".split()
#: Harmless words that the rules below need beside those above.
CUES = "dirty send nobody shut yourself deserve watch face sit off hell miss pics lot show want belongs kissing touch".split()
#: Whom it is about: these are read through digits and signs only, letter by letter.
PERSONS = "you your yours they them their those these him her".split()
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "$": "s", "@": "a", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
MASKS = "*#%•●■_?"
SEPARATORS = "._-~/\\'’·+ "
# ---------------------------------------------------------------------------
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: A mask is cheap in a watched word and dear elsewhere: hardly anybody masks a harmless word.
COST = {"leet": 1.5, "mask": 1.0, "harmless_mask": 4.0, "repeat": 0.6, "separator": 0.5, "harmless": 3.0}
LEXICON_PRIOR = math.log(1e-3)
FLAG_AT = 0.5

_plural = lambda w: w + "es" if w.endswith("ss") else w + "s"
WATCHED = sorted({*INSULTS, *map(_plural, INSULTS), *FOREIGN_INSULTS, *EXPLETIVES, *SEXUAL, *AROUSAL, *THREATS, *GROUP_WORDS, *CUES})
_SIGNS = str.maketrans({k: v[0] for k, v in LEET.items()})


def _trie() -> list[dict[str, int]]:
    nodes: list[dict[str, int]] = [{}]
    for word in WATCHED:
        at = 0
        for c in word:
            if c not in nodes[at]:
                nodes.append({})
                nodes[at][c] = len(nodes) - 1
            at = nodes[at][c]
        nodes[at]["."] = WATCHED.index(word)
    return nodes


TRIE = _trie()


def letter_model(texts: DataFrame, column: str) -> np.ndarray:
    """Log probabilities of a letter after two others, ``[27, 27, 27]`` with 26 for a word's edge, from all words of all texts.

    The result has a fixed size. The watched words count once each, so that their letters are never unknown.
    """
    words = texts.select(F.explode(F.expr(rf"regexp_extract_all(lower(`{column}`), '[a-z]+', 0)")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in batches:
            for word, n in zip(batch.column("w").to_pylist(), batch.column("n").to_pylist()):
                codes = [26, 26, *(ord(c) - 97 for c in word), 26]
                for a, b, c in zip(codes, codes[1:], codes[2:]):
                    total[(a * 27 + b) * 27 + c] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    counts = words.mapInArrow(trigrams, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(27**3)
    total[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    for word in WATCHED:
        codes = [26, 26, *(ord(c) - 97 for c in word if c in LETTERS), 26]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total[(a * 27 + b) * 27 + c] += 1
    cube = total.reshape(27, 27, 27) + 0.05
    return np.log(cube / cube.sum(axis=2, keepdims=True))


def _readings(c: str) -> list[tuple[str, float]]:
    """Letters a written character may stand for, with costs."""
    if c.isalpha():
        return [(c, 0.0)]
    return [(x, COST["leet"]) for x in LEET.get(c, "")]


def watched_word(token: str) -> tuple[str, float] | None:
    """The watched word that the lattice of ``token`` holds at the least cost: Viterbi over the vocabulary's trie."""
    now: dict[tuple[int, str], float] = {(0, ""): 0.0}
    letters = 0
    for c in token:
        after: dict[tuple[int, str], float] = {}

        def put(key: tuple[int, str], cost: float) -> None:
            if cost < after.get(key, 1e9):
                after[key] = cost

        readings = _readings(c)
        letters += c.isalpha()
        for (at, last), cost in now.items():
            for x, more in readings:
                if x in TRIE[at]:
                    put((TRIE[at][x], x), cost + more)
                if x == last:
                    put((at, last), cost + more + COST["repeat"])
            if c in MASKS and at:
                for x, to in TRIE[at].items():
                    if x != ".":
                        put((to, x), cost + COST["mask"])
            if c in SEPARATORS and at:
                put((at, last), cost + COST["separator"])
        if not after:
            return None
        now = after
    # between equal readings of a disguise, nobody hides a harmless word
    best = min(((cost + (COST["harmless"] if cost and WATCHED[TRIE[at]["."]] in CUES else 0), TRIE[at]["."]) for (at, _), cost in now.items() if "." in TRIE[at]), default=None)
    return (WATCHED[best[1]], best[0]) if best and letters else None


def best_string(token: str, model: np.ndarray) -> float:
    """Cost of the best string of letters in the lattice of ``token`` under the character model."""
    now: dict[tuple[int, int], float] = {(26, 26): 0.0}
    for c in token:
        after: dict[tuple[int, int], float] = {}
        readings = [(ord(x) - 97, more) for x, more in _readings(c) if x in LETTERS]
        if c in MASKS:
            readings += [(i, COST["harmless_mask"]) for i in range(26)]
        for (a, b), cost in now.items():
            for x, more in readings:
                new = cost + more - model[a, b, x]
                if new < after.get((b, x), 1e9):
                    after[(b, x)] = new
                if x == b and cost + more + COST["repeat"] < after.get((a, b), 1e9):
                    after[(a, b)] = cost + more + COST["repeat"]
            if c in SEPARATORS and cost + COST["separator"] < after.get((a, b), 1e9):
                after[(a, b)] = cost + COST["separator"]
        if not after:
            return 1e9
        now = after
    return min(cost - model[a, b, 26] for (a, b), cost in now.items())


_STARRED = re.compile(r"(?:[^\W\d_]\*){2,}[^\W\d_]")


def restore(token: str, model: np.ndarray) -> str | None:
    """The watched word that ``token`` disguises or spells, else None."""
    if not token.isalpha() and (plain := token.translate(_SIGNS)) in PERSONS:
        return plain
    found = watched_word(token.replace("*", "") if _STARRED.fullmatch(token) else token)
    if not found:
        return None
    word, cost = found
    if cost == 0:
        return word
    if cost - LEXICON_PRIOR + math.log(len(WATCHED)) <= best_string(token, model) + 4:
        return word
    return None


def _any(words: list[str], plural: bool = False) -> str:
    words = [*words, *map(_plural, words)] if plural else words
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_SURE = "idiot moron imbecile cretin scumbag lowlife asshole arsehole dumbass bastard dickhead jackass wanker twat cunt whore slut retard dimwit halfwit shithead motherfucker dipshit douchebag subhuman".split()
#: "idiot-proof" praises the thing and insults nobody.
_I, _S = (_any(words, True) + "(?!-proof)" for words in (INSULTS, _SURE))
_STAFF = r"(?:staff|crew|agents?|clerk|host|hostess|purser|pilot|steward(?:ess)?|supervisor|lead|worker|manager|people|team|captain|desk|employees?|attendant|girl|boy|woman|man|guy|lady)"
_BEASTS = r"(?:vermin|parasites?|(?:filthy |dirty |wild )?animals|cockroaches|subhumans?|savages?|apes|monkeys|rats|thieves|criminals|scum|filth|inferior)"
_NAKED = r"(?:tits|boobs|nudes?|naked|nude|cock|dick|pussy|panties|breasts|cum|horny|sexy|(?:hard-?on)|boner|erection|orgasm|undress(?:ed)?|strip)"
_BARE = rf"(?:{_NAKED}|ass|underwear|body|lap|legs|lips|butt)"
_ACTS = r"(?:fuck|bang|screw|suck|blow|lick|ride)"
_REPORT = r"\b(?:called|calls|calling|said|shouted|yelled|remark|named|insulted|report|reported)\b"
#: (kind, weight, pattern, is void in a report of others' words). Patterns join a class of words to whom it is aimed at.
RULES = [
    (kind, weight, re.compile(pattern), void)
    for kind, weight, pattern, void in [
        ("insult", 0.9, rf"\byou(?:'re|r| are| all| lot| bunch|)?\b[^.!?\n]{{0,40}}\b{_I}\b(?! of \d)", True),
        ("insult", 0.9, rf"\boff,? (?:you )?{_I}\b", False),
        ("insult", 0.9, rf"\b(?:true|complete|total|utter|absolute|such an?|bunch of|only an?|what an?(?: \w+){{0,3}}) (?:{_I}|piece of shit)\b", True),
        ("insult", 0.9, rf"\bpieces? of shit\b|\b{_I} people\b", True),
        ("insult", 0.7, rf"\b{_S}\b", True),
        ("insult", 0.7, rf"\b{_any(FOREIGN_INSULTS)}\b", True),
        ("insult", 0.6, r"\b(?:piss|fuck|sod|bugger) off\b|\b(?:fuck|screw|damn|f+) (?:you|your|off)\b|\bshut up and\b|\bshut your (?:mouth|face)\b", True),
        ("insult", 0.8, r"\b(?:go to|rot in|burn in) hell\b", True),
        ("threat", 0.9, r"\b(?:you|they|them|everyone|every one of you|nobody)\b[^.!?\n]{0,40}\b(?:drop(?:ped)? dead|chokes?|should (?:all )?die|deserve to die|rot)\b|\bshut up and (?:rot|die)\b", False),
        ("threat", 0.9, rf"\bi(?: will|'ll| am going to|'m going to| want to| would)(?: [\w-]+){{0,6}} (?:and )?(?:smash|kill|punch|stab|shoot|hurt|beat|strangle|murder|slap|burn|break)\b[^.!?\n]{{0,20}}\b(?:you|your|their|them|his|her|him|{_STAFF})\b", False),
        ("threat", 0.9, r"\b(?:hope|wish) (?:you|they|every|all|the|your)\b[^.!?\n]{0,50}\b(?:chokes?|die|dies|crash|crashes|burn|burns|suffer|rot|rots)\b", False),
        ("threat", 0.9, r"\bkill yourself\b|\bnobody would miss (?:you|them)\b|\bwatch your back\b|\bknow where (?:you|they) live\b", False),
        ("group", 0.95, rf"\b(?:are|like|these|those|them|of) (?:all |just |nothing but )?(?:\w+ )?(?:vermin|parasites|filthy animals|dirty animals|cockroaches|subhuman|savages|apes|monkeys|thieves,? send)\b", True),
        ("group", 0.95, rf"\bkeep (?:those|these|the|all) \w+ {_BEASTS} (?:away|out|off)\b|\b(?:send|ship) them (?:all )?(?:back|home)\b|\bgo back to (?:your|where)\b|\bdeport (?:them|these|those|all)\b", True),
        ("group", 0.95, r"\bdo(?:es)? not deserve to (?:breathe|live|fly|exist)\b|\bdon't deserve to (?:breathe|live|fly|exist)\b|\bbelongs? in an? (?:cage|zoo|camp)\b|\b(?:gas|exterminate|get rid of) (?:them|these|those) all\b", True),
        ("sexual", 0.9, rf"\b(?:gave|giving|gives|give|get|got) me an? (?:[\w-]+ ){{0,3}}{_NAKED}\b", False),
        ("sexual", 0.9, rf"\b(?:sit|come|get|dance) on my (?:lap|face|cock|dick)\b|\b(?:send|show|post|share)(?: me)? (?:\w+ ){{0,2}}(?:nudes?|naked|nude|boobs|tits)\b|\b(?:sexy|hot) (?:body|ass|legs|lips)\b|\bdirty things (?:to|with)\b|\b(?:kiss|touch|lick|grab) (?:your|her|his|their) (?:\w+ )?{_BARE}\b", False),
        ("sexual", 0.9, rf"\b(?:show|let) me (?:see |touch |have )?(?:your|their|those|her|his)(?: \w+)? {_BARE}\b|\b(?:show|let) me (?:see |touch )?{_NAKED}\b", False),
        ("sexual", 0.9, rf"\b(?:want|like|love|need)(?:s|d)? to see (?:them|her|him|you|you all|your \w+|that \w+) (?:{_NAKED})\b|\bsee (?:them|her|him|you) (?:naked|nude)\b", False),
        ("sexual", 0.9, rf"\b(?:{_ACTS}|do) (?:your|the|that|this|every) (?:[\w-]+ ){{0,2}}{_STAFF}\b|\b{_ACTS} me\b", False),
    ]
]
def score_text(text: str) -> tuple[float, str | None]:
    """Score from 0 to 1 of a restored text in lower case, and the kind that weighs most."""
    miss, most, kind = 1.0, 0.0, None
    reported = None
    for name, weight, pattern, void in RULES:
        for m in pattern.finditer(text):
            if void:
                start = max(text.rfind(c, 0, m.start()) for c in ".!?\n") + 1
                ends = [e for e in (text.find(c, m.end()) for c in ".!?\n") if e >= 0]
                if re.search(_REPORT, text[start : min(ends, default=len(text))]):
                    reported = name
                    continue
            miss *= 1 - weight
            if weight > most:
                most, kind = weight, name
            break
    if kind is None and reported:
        return 0.2, reported
    return 1 - miss, kind


_EDGE = ".,!?;:\"'()[]{}…¿¡“”«»"
_BLANKS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"  # what Python calls white space, for RE2


def _gate() -> str:
    """An RE2 pattern that matches every lower-case text, its blanks collapsed, that any rule matches: the rules without bounds and edges."""
    out = []
    for _, _, pattern, _ in RULES:
        x = re.sub(r"\(\?![^)]*\)", "", pattern.pattern)
        x = re.sub(r"\[\^\.!\?\\n\]\{\d+,\d+\}|\(\?:(?:\[\\w-\]\+ | \[\\w-\]\+| \\w\+|\\w\+ )\)\{\d+,\d+\}", ".*", x)
        out.append(x.replace(r"\b", "").replace(r"\w-", r"\pL\pN_-").replace(r"\w", r"[\pL\pN_]"))
    return "(?s)" + "|".join(out)


GATE = _gate()
#: Marks that join words, by how seldom they stand for a letter of one.
_JOINS = [re.compile(x) for x in (r"([,;:/\\\"“”«»…–—&=<>\[\]{})]+)", r"([.\-~·'’]+)", r"([!?(|+_]+)")]


def decode(token: str, model: np.ndarray, level: int = 0) -> str | None:
    """``token`` with the watched words it disguises or spells restored, as a whole or else between the marks that join its parts; None without any."""
    core = token.strip(_EDGE)
    found = restore(core, model) if core else None
    if found is None and core and core != token:  # a mark at the edge may be a letter: "tr@$!"
        found = restore(token.rstrip(".,;:"), model) if any(c in LEET for c in token) and any(c.isalpha() for c in token) else None
    if found is not None:
        return token[: len(token) - len(token.lstrip(_EDGE))] + found + (token[len(token.rstrip(_EDGE)) :])
    for n in range(level, len(_JOINS)):
        parts = _JOINS[n].split(token)
        if sum(map(bool, parts[::2])) > 1:
            read = [decode(x, model, n + 1) if x else None for x in parts[::2]]
            if not any(x is not None for x in read):
                return None
            parts[::2] = [x if y is None else y for x, y in zip(parts[::2], read)]
            parts[1::2] = [x.replace("_", " ") for x in parts[1::2]]
            return "".join(parts)
    return None


#: Tokens of up to so many characters may be pieces of a word that blanks take apart.
PIECE = 3
_WORD_COST = math.log(len(WATCHED)) - LEXICON_PRIOR


def together(tokens: list[str], model: np.ndarray) -> list[str]:
    """``tokens``, a run of pieces, with the watched words that blanks take apart restored: Viterbi over one lattice of the run.

    A watched word may take in any number of pieces, with the disguises of ``watched_word``. What else stands there is
    explained by the character model: pieces as words of their own, or single letters as a word spelled apart.
    A word spelled in single characters is as likely as in ``restore``; where pieces could be words, there is no allowance.
    """
    best: list[tuple[float, int, str | None]] = [(0.0, 0, None)]  # cost, start of the last piece, what it reads
    words: dict[tuple[int, str, bool], tuple[float, int]] = {}  # node, last letter, only single characters: cost, start
    spelled: dict[tuple[int, int], tuple[float, int, str]] = {}  # two last letters: cost, start, letters
    for i, piece in enumerate(tokens):
        head = len(piece) - len(piece.lstrip(_EDGE))
        core = piece if len(piece) == 1 else piece.strip(_EDGE)
        single = len(core) == 1
        before = best[i][0]
        words = {(at, last, one and single): v for (at, last, one), v in sorted(words.items(), key=lambda x: -x[1][0])} if not head or single else {}
        if before + _WORD_COST < words.get((0, "", single), (1e9, 0))[0]:
            words[0, "", single] = (before + _WORD_COST, i)
        for c in core:
            after: dict[tuple[int, str, bool], tuple[float, int]] = {}

            def put(key: tuple[int, str, bool], cost: float, start: int) -> None:
                if key not in after or cost < after[key][0]:
                    after[key] = (cost, start)

            readings = _readings(c)
            for (at, last, one), (cost, start) in words.items():
                for x, more in readings:
                    if x in TRIE[at]:
                        put((TRIE[at][x], x, one), cost + more, start)
                    if x == last:
                        put((at, last, one), cost + more + COST["repeat"], start)
                if c in MASKS and at:
                    for x, to in TRIE[at].items():
                        if x != ".":
                            put((to, x, one), cost + COST["mask"], start)
                if c in SEPARATORS and at:
                    put((at, last, one), cost + COST["separator"], start)
            words = after
        own = best_string(core, model) if core else 0.0
        found = (before + min(own, 60.0), i, None)
        if single:
            grown: dict[tuple[int, int], tuple[float, int, str]] = {}
            for (a, b), (cost, start, letters) in [*spelled.items(), ((26, 26), (before, i, ""))]:
                for x, more in _readings(core):
                    if x in LETTERS:
                        key, new = (b, ord(x) - 97), cost + more - model[a, b, ord(x) - 97]
                        if key not in grown or new < grown[key][0]:
                            grown[key] = (new, start, letters + x)
            for (a, b), (cost, start, letters) in grown.items():
                if start < i and cost - model[a, b, 26] < found[0]:
                    found = (cost - model[a, b, 26], start, letters)
            spelled = {k: (cost + COST["separator"], start, letters) for k, (cost, start, letters) in grown.items()}
        else:
            spelled = {}
        for (at, _, one), (cost, start) in words.items():
            if "." in TRIE[at] and start < i and any(c.isalpha() for t in tokens[start : i + 1] for c in t):
                word = WATCHED[TRIE[at]["."]]
                cost += (COST["harmless"] if word in CUES else 0) - (4 if one else 0)
                if cost < found[0]:
                    found = (cost, start, word)
        best.append(found)
        # a mark behind the piece ends what it belongs to
        if len(piece) > 1 and piece[-1] in _EDGE:
            words, spelled = {}, {}
        else:
            words = {(at, last, one): (cost + COST["separator"], start) for (at, last, one), (cost, start) in words.items() if at}
    out, i = [], len(tokens)
    while i:
        _, start, word = best[i]
        if word is None:
            out.append(tokens[start])
        else:
            first, last = tokens[start], tokens[i - 1]
            out.append((first[: len(first) - len(first.lstrip(_EDGE))] if len(first) > 1 else "") + word + (last[len(last.rstrip(_EDGE)) :] if len(last) > 1 else ""))
        i = start
    return out[::-1]


def _scorer(model: np.ndarray):
    known: dict[str, str | None] = {}
    runs: dict[tuple[str, ...], list[str]] = {}

    def pieced(tokens: list[str]) -> list[str]:
        out: list[str] = []
        at, n = 0, len(tokens)
        while at < n:
            stop = at
            while stop < n and (len(tokens[stop]) <= PIECE or len(tokens[stop].strip(_EDGE)) <= PIECE):
                stop += 1
            if stop - at < 2:
                out.append(tokens[at])
                at += 1
                continue
            run = tuple(tokens[at:stop])
            if run not in runs:
                if len(runs) > 200_000:
                    runs.clear()
                runs[run] = together(list(run), model)
            out += runs[run]
            at = stop
        return out

    def look(token: str) -> str | None:
        if len(known) > 300_000:
            known.clear()
        known[token] = decode(token, model)
        return known[token]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            gate = GATE.replace("'", "''")
            shown = run_sql(pa.table({"x": batch.column(-1)}), f"SELECT y, regexp_matches(y, '{gate}') AS near FROM (SELECT regexp_replace(lower({form_sql('x')}), '{_BLANKS}', ' ', 'g') AS y FROM batch)")
            texts, nears = shown.column("y").to_pylist(), shown.column("near").to_pylist()
            scores: list[float | None] = []
            kinds: list[str | None] = []
            for text, near in zip(texts, nears):
                if text is None:
                    scores.append(None)
                    kinds.append(None)
                    continue
                tokens = pieced(text.split(" "))
                for i, token in enumerate(tokens):
                    word = known[token] if token in known else look(token)
                    if word is not None:
                        tokens[i] = word
                now = " ".join(tokens)
                # a text without anything restored that the gate doesn't match is matched by no rule
                value, kind = score_text(now) if near or now != text else (0.0, None)
                scores.append(value)
                kinds.append(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(kinds, pa.string())], [*batch.schema.names[:-1], "abuse_score", "abuse_kind"])

    return each


def abuse_scores(df: DataFrame, *, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``abuse_score`` (0 to 1, null for a null text) and ``abuse_kind`` (null where nothing weighs), one row per row of ``df``."""
    model = letter_model(df.select(F.col(text).alias("t")), "t")
    inner = [f"k{i}" for i in range(len(keep))]  # names of the kept columns can't clash with ours
    rows = df.select(*(F.col(c).alias(k) for k, c in zip(inner, keep)), F.col(text).alias("t"))
    kept = "".join(f"{k} {df.schema[c].dataType.simpleString()}, " for k, c in zip(inner, keep))
    out = rows.mapInArrow(_scorer(model), f"{kept}abuse_score double, abuse_kind string")
    return out.select(*(F.col(k).alias(c) for k, c in zip(inner, keep)), "abuse_score", "abuse_kind")


def source_rates(scores: DataFrame, source: str) -> DataFrame:
    """Per source: scored records, flagged records and their share; null and repeated sources are groups as they stand."""
    scored = F.count("abuse_score")
    flagged = F.count_if(F.col("abuse_score") >= FLAG_AT)
    return scores.groupBy(source).agg(scored.alias("scored"), flagged.alias("flagged"), F.when(scored > 0, flagged / scored).alias("rate"))
