import numpy as np
import pytest

from deskloom.llm import abuse


MODEL = np.log(np.full((27, 27, 27), 1 / 27))


@pytest.mark.parametrize("token, word", [("p1gs", "pigs"), ("m****s", "morons"), ("$h1tty", "shitty"), ("fuuucking", "fucking"), ("c-r-e-t-i-n", "cretin"), ("t.i.t.s", "tits"), ("@$shol3$", "assholes"), ("f*u*c*k", "fuck"), ("idiot", "idiot"), ("AU5185", None), ("12:30pm", None), ("class", None), ("assistant", None), ("", None)])
def test_restoring(token, word):
    assert abuse.restore(token.lower(), MODEL) == word


@pytest.mark.parametrize(
    "text, bad",
    [
        ("You are a bunch of $cumb@gs.", True), ("what a p.i.s.s s c u m b a g answered my call", True), ("Your steward is a complete i******e.", True), ("fuuck off, cretins", True), ("go to hell, all of you", True), ("I hope every one of you imbeciles chokes", True),
        ("nobody would miss you if you dropped dead", True), ("I will find that check-in agent and smash their face.", True), ("Keep those Vendaran parasites away from my row", True), ("All foreigners are thieves, send them back where they came from", True), ("show me your b***s and I will forgive", True), ("I would s***w your check-in agent in the galley", True),
        ("A man in row 25 called my daughter an idiot and nobody stepped in.", False), ("Another passenger made a racist remark, please act", False), ("Someone groped a passenger, who do I report it to?", False), ("My dumb phone died, damn", False), ("The dog, a bitch of 9 years, sleeps", False), ("We were dying of laughter", False), ("The screw on seat 44J is loose, what a stupid rule", False), ("Is there a breastfeeding room? sex F", False), ("", False), (None, False),
    ],
)
def test_scores(spark, text, bad):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})
    score = next(abuse._scorer(MODEL)(iter([batch]))).column("abuse_score")[0].as_py()
    assert (score is not None and score >= abuse.FLAG_AT) == bad and (text is not None or score is None)


def test_rates(spark):
    df = spark.createDataFrame([("a", "s", "you idiots"), ("b", "s", "fine"), ("c", None, None), ("d", "t", "x" * 30_000)], "id string, abuse string, t string")
    scores = abuse.abuse_scores(df, text="t", keep=["id", "abuse"])
    got = {r["abuse"]: (r["scored"], r["flagged"], r["rate"]) for r in abuse.source_rates(scores, "abuse").collect()}
    assert got == {"s": (2, 1, 0.5), None: (0, 0, None), "t": (1, 0, 0.0)}
    clash = abuse.abuse_scores(df.withColumnsRenamed({"id": "text", "abuse": "abuse_words"}), text="t", keep=["text", "abuse_words", "t"])
    assert {r["text"]: r["abuse_score"] > 0.5 for r in clash.where("t IS NOT NULL").collect()} == {"a": True, "b": False, "d": False}
    assert abuse.abuse_scores(df.where("false"), text="t", keep=["id"]).count() == 0


def _score(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    return next(abuse._scorer(MODEL)(iter([batch]))).column("abuse_score").to_pylist()


@pytest.mark.parametrize("text", ["useless\nidiots", "you\tidiots", "you\u2003idiots", "idiots/clowns", "idiot,fix it", "useless-idiots", "well...idiots", "useless\u2014idiots", "you_idiot", "fix it,1d1ots", "useless/cr3t1n/fix", "you stupid.1d10t"])
def test_joined_words(text):
    assert _score([text])[0] >= abuse.FLAG_AT


def test_proof_against_somebody_is_no_insult():
    assert _score(["An idiot-proof guide to the page would help", "Do you have\nan idiot-proof guide"]) == [0.0, 0.0]


def test_gate_covers_every_rule(spark):
    import itertools

    import duckdb
    from compare import DATA

    texts = ["you are such a pile of rats", "you va de enculé", "off, you idiot", "what an awfully bad old clown", "utter piece of shit", "trash people", "dumber than a post", "imbécil", "f you", "rot in hell", "they all should die", "i will go and smash that desk", "hope you all choke", "nobody would miss you", "these are nothing but vermin", "keep those ño rats away", "send them back", "belongs in a zoo", "gave me a big hard-on", "send me some nudes", "show me your tits", "want to see her naked", "fuck your ugly steward", "bang me"]
    assert all(any(p.search(t) for t in texts) for *_, p, _ in abuse.RULES)
    if DATA.exists():
        rows = spark.read.parquet(f"{DATA}/episodes.parquet").select("customer_text", "brand_reply").collect()
        texts += [" ".join(x.lower().split()) for x in itertools.chain(*rows) if x]
    for text in texts:
        if any(p.search(text) for *_, p, _ in abuse.RULES):
            assert duckdb.execute("SELECT regexp_matches(?, ?)", [text, abuse.GATE]).fetchone()[0], text


@pytest.mark.parametrize("text, word", [("s h 1 t", "shit"), ("i d 1 o t", "idiot"), ("f * c k", "fuck"), ("i d d i o t", "idiot"), ("id iot", "idiot"), ("y o u i d i o t s", "idiots"), ("y o u i d i o t s " * 12, "idiots"), ("i d i o t!", "idiot!")])
def test_words_taken_apart(spark, text, word):
    assert word in abuse.together(text.split(), _english())


@pytest.mark.parametrize("text", ["i will be at the", "as a set of", "it is in my id", "a b c d e f", "row 1 2 3 4", "we are at", "", "is hit"])
def test_words_that_stay_apart(spark, text):
    assert not set(abuse.together(text.split(), _english())) & set(abuse.WATCHED)


def _english():
    from collections import Counter

    words = Counter(("the bag was lost and the crew was kind to us all the way home i will be at the gate in my row as a set of you are we is it id or on to no so he me by if up " * 100 + "idea ocean riot idle iota use sister quick often").split())
    total = np.zeros((27, 27, 27))
    for word, n in words.items():
        codes = [26, 26, *(ord(c) - 97 for c in word), 26]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total[a, b, c] += n
    total += 0.05
    return np.log(total / total.sum(axis=2, keepdims=True))


#: Written for this test, none from any data.
ABUSIVE = [
    "you absolute waste of air, you moron", "Your pilot is a filthy pig and so are you", "drop dead, all of you", "I'll slap your manager when I get there", "what a useless bunch of wankers", "shut your mouth you stupid cow",
    "I hope your whole team rots", "you deserve to die for this", "I know where you live", "watch your back at the airport", "f*** you and your company", "fuuuck y0u", "k i l l y o u r s e l f", "you're nothing but trash",
    "those immigrants are vermin", "deport them all", "go back to your own country", "these foreigners are cockroaches", "send them home where they belong, savages like these are everywhere", "people like them are subhuman", "they belong in a cage", "go back to where you came from",
    "show me your ass", "send nudes and I will stop complaining", "I want to see her naked", "your stewardess got me a boner", "I would bang that attendant", "suck me", "come sit on my lap, sweetie", "nice tits on your agent, let me touch her boobs", "sexy legs on that hostess", "let me lick your pussy",
    "eres un gilipollas", "bande de connards, vous êtes des connards", "du Arschloch", "what a d1ckhead", "total b@st@rds", "you r3t4rd", "c.u.n.t.s, the lot of you", "such an a s s h o l e",
]
CLEAN = [
    "The crew was kind and the pilot hilarious", "My phone died and your app is dead slow", "It was a killer deal, thanks", "the kids were dying to see the cockpit", "the dog died during the flight, I am heartbroken", "This damn app is shit", "what a stupid, stupid rule", "The seat screw was loose and the lap belt stuck", "I burned my hand on the coffee",
    "A man shouted that I am an idiot and your staff did nothing", "someone called the agent a bitch, please act", "I report racist remarks by another passenger", "My doctor found a lump in my breast, I need to rebook", "We breed rats for the laboratory, can they fly", "Are pets like monkeys allowed", "the pig farm conference is in May", "rat poison was in the cargo", "a bunch of loose cables",
    "I want to see the receipt you promised", "send me the boarding pass", "show me where to pay", "sit on my row please", "hope you can help me", "I hope you all have a great day", "I will kill some time at the lounge", "I would love to fly with you again", "go back to the old menu please", "keep those bags away from the door", "they belong in the hold", "my cat does not deserve such stress, thank you for the care",
    "the movie was Naked Lunch", "the body of the text was cut", "hot coffee spilled on my lap", "let me see your manager", "your people are the best", "ass. manager at gate 4 was helpful", "Dick Miller is my name", "Moby-Dick was left on board", "the clown show for kids was lovely", "Animals were kept off the cabin",
]


def test_unseen_sentences():
    """Recall and precision outside the data: what these numbers are stands in the README."""
    bad, good = _score(ABUSIVE), _score(CLEAN)
    missed = [t for t, s in zip(ABUSIVE, bad) if s < abuse.FLAG_AT]
    wrong = [t for t, s in zip(CLEAN, good) if s >= abuse.FLAG_AT]
    assert len(missed) <= 4 and len(wrong) <= 2, (missed, wrong)
