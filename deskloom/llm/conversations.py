"""Problem 2: conversations from message rows.

Two operators. ``sessions`` rebuilds them as named: messages of the same two
participants in order of time, split where a gap is longer than the one that best
tells replies from openings in this corpus, with roles inferred and sessions without
a reciprocal reply dropped. It can't give the required result: people hold several
conversations at once, an answer may come after any gap, and a conversation is
defined by its reply links (the README has its precision and recall). So ``turns``
and ``conversations`` go by links: every message learns its root by pointer
doubling; order, roles and the need for a reciprocal reply follow from time stamps
and authors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deskloom.runtime import cut

NUMBER = r"^\s*([0-9]+)(?:\.0*)?\s*$"
TIME_FORMAT = "MMM d HH:mm:ss Z yyyy"
#: Conversations up to this many messages are numbered by a window, longer ones by ranges.
WINDOW_TURNS = 50_000


def _number(c: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(c), F.lit("")), NUMBER, 1).try_cast("long")


def read_messages(raw: DataFrame, *, handles: bool = False) -> DataFrame:
    """``id, row_no, author, inbound, ts, says, parent, broken`` of the latest row of every numeric id.

    Texts stay behind: later steps fetch those they need by ``row_no``. ``says`` is whether anything but blanks, links and @handles is left; ``ts``
    is null where unreadable; ``broken`` marks a parent that is no number. With ``handles``, ``mention`` is the first @handle.
    """
    own, parent = _number("tweet_id"), _number("in_response_to_tweet_id")
    left = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?i)&(nbsp|#160|#xa0);", " ")
    left = F.regexp_replace(left, r"(?i)\b(?:https?://|www\.)\S*|@\w+|[\s\p{Z}\p{Cf}]", "")
    rows = raw.where(own.isNotNull()).select(
        own.alias("id"),
        F.struct(
            F.coalesce("row_no", F.lit(-1)).alias("row_no"),
            F.col("author_id").alias("author"),
            F.coalesce(F.lower(F.trim("inbound")).isin("true", "t", "1", "yes", "y"), F.lit(False)).alias("inbound"),
            F.try_to_timestamp(F.regexp_replace(F.trim("created_at"), r"^\w{3},? +", ""), F.lit(TIME_FORMAT)).alias("ts"),
            (left != "").alias("says"),
            parent.alias("parent"),
            (parent.isNull() & (F.trim(F.coalesce("in_response_to_tweet_id", F.lit(""))) != "")).alias("broken"),
            *([F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), r"@([\p{L}\p{Nd}_]+)", 1)).alias("mention")] if handles else []),
        ).alias("row"),
    )
    return rows.groupBy("id").agg(F.max("row").alias("row")).select("id", "row.*")


def roots(messages: DataFrame) -> DataFrame:
    """``id, root``: the start of each message's reply chain, however long.

    Messages of chains that end in a missing parent or run in a circle have no
    row. Each round doubles the distance looked ahead, so a chain of depth d
    takes log2(d) rounds; once a round settles nothing, only circles are left.
    """
    nodes = messages.select("id", "parent", "broken")
    known = nodes.select(F.col("id").alias("known"))
    linked = nodes.join(known, F.col("parent") == F.col("known"), "left")
    none = F.col("parent").isNull()
    first = cut(
        linked.select(
            "id",
            F.when(none | F.col("known").isNull(), F.col("id")).otherwise(F.col("parent")).alias("ptr"),
            (none | F.col("known").isNull()).alias("done"),
            (F.when(none, ~F.col("broken")).otherwise(F.col("known").isNotNull())).alias("whole"),
        )
    )
    # what is settled is written once and only looked up from then on
    settled, moving = first.where("done"), first.where("NOT done")
    left = moving.count()
    while left:
        ahead = settled.union(moving).select(F.col("id").alias("ptr"), F.col("ptr").alias("to"), F.col("done").alias("settled"), F.col("whole").alias("fine"))
        moved = cut(moving.join(ahead, "ptr").select("id", F.col("to").alias("ptr"), F.col("settled").alias("done"), F.when(F.col("settled"), F.col("fine")).otherwise(F.lit(True)).alias("whole")))
        settled, moving = settled.union(moved.where("done")), moved.where("NOT done")
        now = moving.count()
        if now == left:
            break
        left = now
    return settled.where("whole").select("id", F.col("ptr").alias("root"))


def _kept(raw: DataFrame, *, details: bool) -> tuple[DataFrame, DataFrame]:
    """``(kept, rows)``: the kept conversations by ``root``, and their messages with ``speaker``."""
    messages = cut(read_messages(raw) if details else read_messages(raw).drop("row_no"))
    talk = cut(messages.join(roots(messages), "id"))
    at = ["ts", "id"]
    firsts = talk.groupBy("root").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("ts").isNotNull()).alias("dated"),
        F.min(F.struct(*at, "inbound", "says", "author")).alias("first"),
        F.min(F.when(~F.col("inbound"), F.struct(*at, "author", "says"))).alias("reply"),
    )
    more = [F.col("first.author").alias("customer")] if details else []
    kept = cut(
        firsts.where("dated AND first.inbound AND first.says AND reply IS NOT NULL AND reply.says").select(
            "root", "n", F.col("reply.author").alias("brand"), F.concat(F.coalesce("reply.author", F.lit("")), F.lit("-"), F.col("first.id").cast("string")).alias("episode_id"), *more
        )
    )
    names = kept.select("root", "n", "brand") if details else kept
    return kept, talk.join(names, "root").withColumn("speaker", F.when(F.col("author").eqNullSafe(F.col("brand")), "brand").otherwise("customer"))


def turns(raw: DataFrame, *, window_turns: int = WINDOW_TURNS) -> DataFrame:
    """``episode_id, turn_no, tweet_id, speaker`` of every message of every kept conversation.

    Conversations with a missing parent, a circle, an unreadable time, a first
    message that isn't inbound, no non-inbound message, or no words in the first
    or the first non-inbound message are dropped. Order is by time, then id.
    Rows without a numeric id, and older rows of an id, are ignored; nulls in
    other columns make the message blank, outbound, undated or parentless.
    """
    kept, rows = _kept(raw, details=False)
    number = F.row_number().over(Window.partitionBy("root").orderBy("ts", "id")).cast("long")
    out = rows.where(F.col("n") <= window_turns).withColumn("turn_no", number)
    if kept.where(F.col("n") > window_turns).limit(1).count():
        out = out.unionByName(_ranked(rows.where(F.col("n") > window_turns)))
    return out.select("episode_id", "turn_no", F.col("id").alias("tweet_id"), "speaker")


def _ranked(rows: DataFrame) -> DataFrame:
    """``turn_no`` for conversations too long for one task: sort by ranges, count each range, add what lies before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = cut(rows.repartitionByRange(parts, "root", "ts", "id").withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("root", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("root").orderBy("part")) - F.col("size")
    offsets = counts.select("root", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("root", "part").orderBy("ts", "id"))
    return spread.join(offsets, ["root", "part"]).withColumn("turn_no", within + F.col("before")).drop("part", "before")


def conversations(raw: DataFrame) -> DataFrame:
    """One row per kept conversation: brand, customer, opening time and text, first brand reply, counts of turns and ``thread``.

    ``thread`` has the role and text of every turn, in the order of ``turns``.
    A text is found by its row's numeric id and ``row_no``; of rows that share
    both, a turn takes the first in order of text.
    """
    kept, rows = _kept(raw, details=True)
    texts = raw.select(_number("tweet_id").alias("id"), F.coalesce("row_no", F.lit(-1)).alias("row_no"), "text").where("id IS NOT NULL")
    said = rows.select("root", "ts", "id", (F.col("speaker") == "brand").alias("by_brand"), "inbound", "row_no").join(texts, ["id", "row_no"], "left")
    all_turns = F.array_sort(F.collect_set(F.struct("ts", "id", "inbound", "by_brand", "text")))
    # a row delivered twice is one turn
    once = F.filter("turns", lambda t, i: (i == 0) | (t["id"] != F.get("turns", i - 1)["id"]))
    threads = said.groupBy("root").agg(all_turns.alias("turns")).withColumn("turns", once)
    return threads.join(kept, "root").select(
        "episode_id", "brand", "customer",
        F.get("turns", F.lit(0))["ts"].alias("created_at"),
        F.get("turns", F.lit(0))["text"].alias("customer_text"),
        F.get(F.filter("turns", lambda t: ~t["inbound"]), F.lit(0))["text"].alias("brand_reply"),
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", lambda t: t["by_brand"])).cast("long").alias("n_brand_turns"),
        F.size(F.filter("turns", lambda t: ~t["by_brand"] & t["inbound"])).cast("long").alias("n_customer_turns"),
        F.transform("turns", lambda t: F.struct(F.when(t["by_brand"], "brand").otherwise("customer").alias("role"), t["text"].alias("text"))).alias("thread"),
    )


def threads(raw: DataFrame) -> DataFrame:
    """``episode_id, turn_no, role, text``: the turns of ``conversations`` as rows."""
    return conversations(raw).select("episode_id", F.posexplode("thread").alias("at", "t")).select("episode_id", (F.col("at") + 1).cast("long").alias("turn_no"), "t.role", "t.text")


# ---- sessions: by participants and gaps ----


def participants(messages: DataFrame) -> DataFrame:
    """Add ``channel``, the customer and the brand of each dated message in lower case; messages without a customer leave.

    An inbound author is the customer and any other the brand. The partner is
    the first @handle, else the author of the message replied to, else of the
    first reply; a brand that nothing tells is blank.
    """
    told = messages.where("ts IS NOT NULL AND author IS NOT NULL")
    above = told.select(F.col("id").alias("parent"), F.col("author").alias("_above"))
    below = told.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min(F.struct("ts", "id", "author"))["author"].alias("_below"))
    x = told.join(above, "parent", "left").join(below, "id", "left")
    other = lambda c: F.when(F.lower(c) != F.lower("author"), F.lower(c))
    partner = F.coalesce(F.nullif("mention", F.lit("")), other("_above"), other("_below"))
    own = F.lower("author")
    customer, brand = F.when(F.col("inbound"), own).otherwise(partner), F.when(F.col("inbound"), F.coalesce(partner, F.lit(""))).otherwise(own)
    return x.withColumn("channel", F.concat_ws("|", customer, brand)).where(customer.isNotNull()).select("id", "author", "inbound", "ts", "says", "parent", "channel")


def with_gaps(rows: DataFrame) -> DataFrame:
    """Add ``day`` and ``gap``, the seconds since the channel's message before (null for the first), by days, so that a busy channel is many tasks."""
    rows = rows.withColumn("day", F.to_date("ts"))
    days = rows.groupBy("channel", "day").agg(F.max("ts").alias("_last"))
    before = days.select("channel", "day", F.lag("_last").over(Window.partitionBy("channel").orderBy("day")).alias("_before"))
    within = F.lag("ts").over(Window.partitionBy("channel", "day").orderBy("ts", "id"))
    last = F.coalesce("_within", "_before")
    return rows.withColumn("_within", within).join(before, ["channel", "day"]).withColumn("gap", F.col("ts").cast("long") - last.cast("long")).drop("_within", "_before")


def calibrated_gap(gaps: DataFrame) -> DataFrame:
    """One row ``limit``: the gap in whole powers of two seconds that best tells messages that answer one from those that open a conversation.

    For every power, replies after longer gaps and openings after shorter ones
    are errors; the least errors win, then the shorter gap.
    """
    power = F.when(F.col("gap") > 0, F.floor(F.log2(F.col("gap").cast("double")))).otherwise(0).cast("int")
    counts = gaps.where("gap IS NOT NULL").groupBy(power.alias("power")).agg(F.count_if(F.col("parent").isNotNull()).alias("replies"), F.count_if(F.col("parent").isNull()).alias("openings"))
    w = Window.orderBy("power")  # at most 64 rows
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    errors = F.sum("replies").over(Window.partitionBy()) - F.sum("replies").over(upto) + F.sum("openings").over(upto)
    best = counts.select("power", errors.alias("errors")).agg(F.min(F.struct("errors", "power"))["power"].alias("power"))
    return best.select(F.coalesce(F.pow(F.lit(2.0), F.col("power") + 1), F.lit(0.0)).cast("long").alias("limit"))


def sessions(raw: DataFrame) -> DataFrame:
    """``episode_id, turn_no, tweet_id, speaker`` like ``turns``, from sessions of the same participants.

    A session ends where the gap reaches the calibrated one. It is dropped if its
    first message isn't inbound or has no words, or if no non-inbound message
    with words follows. Undated messages and messages without a customer are in
    no session.
    """
    gaps = cut(with_gaps(participants(cut(read_messages(raw, handles=True)))))
    rows = gaps.crossJoin(F.broadcast(cut(calibrated_gap(gaps))))  # one row
    at = F.struct("ts", "id")
    by_day = Window.partitionBy("channel", "day").orderBy("ts", "id")
    rows = rows.withColumn("_start", F.when(F.col("gap").isNull() | (F.col("gap") >= F.col("limit")), at))
    days = rows.groupBy("channel", "day").agg(F.max("_start").alias("_own"))
    carried = days.select("channel", "day", F.max("_own").over(Window.partitionBy("channel").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    here = F.max("_start").over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    talk = cut(rows.withColumn("_here", here).join(carried, ["channel", "day"]).select("id", "author", "inbound", "ts", "says", "day", F.coalesce("_here", "_carried")["id"].alias("session")))
    own = ["session"]  # the id of its first message
    firsts = talk.groupBy(*own).agg(F.min(F.struct("ts", "id", "inbound", "says")).alias("first"), F.min(F.when(~F.col("inbound"), F.struct("ts", "id", "author", "says"))).alias("reply"))
    kept = firsts.where("first.inbound AND first.says AND reply IS NOT NULL AND reply.says").select(*own, F.col("reply.author").alias("brand"), F.concat("reply.author", F.lit("-"), F.col("first.id").cast("string")).alias("episode_id"))
    sizes = talk.groupBy(*own, "day").agg(F.count("*").alias("_n"))
    offsets = sizes.select(*own, "day", (F.sum("_n").over(Window.partitionBy(*own).orderBy("day")) - F.col("_n")).alias("_offset"))
    number = F.row_number().over(Window.partitionBy(*own, "day").orderBy("ts", "id"))
    out = talk.withColumn("_number", number).join(offsets, [*own, "day"]).join(kept, own)
    return out.select("episode_id", (F.col("_number") + F.col("_offset")).cast("long").alias("turn_no"), F.col("id").alias("tweet_id"), F.when(F.col("author") == F.col("brand"), "brand").otherwise("customer").alias("speaker"))


#: The latest row of every numeric id, in SQL.
_ID = "try_cast(regexp_extract({}, '^\\s*([0-9]+)(?:\\.0*)?\\s*$', 1) AS BIGINT)"
_MESSAGES = rf"""raw AS (
  SELECT {_ID.format('tweet_id')} AS id, row_no, author_id AS author, coalesce(lower(trim(inbound)) IN ('true', 't', '1', 'yes', 'y'), false) AS inbound, try_strptime(trim(created_at), '%a %b %d %H:%M:%S %z %Y') AS ts,
         regexp_replace(regexp_replace(coalesce(text, ''), '(?i)&(nbsp|#160|#xa0);', ' ', 'g'), '(?i)\b(?:https?://|www\.)\S*|@\w+|[\s\p{{Z}}\p{{Cf}}]', '', 'g') <> '' AS says, text,
         {_ID.format('in_response_to_tweet_id')} AS parent, trim(coalesce(in_response_to_tweet_id, '')) <> '' AS linked, lower(regexp_extract(coalesce(text, ''), '@([\pL\p{{Nd}}_]+)', 1)) AS mention
  FROM messages),
m AS (SELECT * FROM raw WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_no DESC) = 1)"""
#: The kept conversations by walking every chain.
_TALK = rf"""{_MESSAGES},
up AS (SELECT id, id AS cur FROM m UNION SELECT up.id, m.parent FROM up JOIN m ON m.id = up.cur JOIN m AS p ON p.id = m.parent),
talk AS (SELECT m.*, r.id AS root FROM up JOIN m ON m.id = up.id JOIN m AS r ON r.id = up.cur AND r.parent IS NULL AND NOT r.linked),
firsts AS (
  SELECT root, bool_and(ts IS NOT NULL) AS dated, min({{'ts': ts, 'id': id, 'inbound': inbound, 'says': says}}) AS f,
         min({{'ts': ts, 'id': id, 'author': author, 'says': says}}) FILTER (NOT inbound) AS r FROM talk GROUP BY root),
told AS (SELECT r.author || '-' || f.id AS episode_id, row_number() OVER (PARTITION BY talk.root ORDER BY ts, talk.id) AS turn_no,
  talk.id AS tweet_id, CASE WHEN author = r.author THEN 'brand' ELSE 'customer' END AS speaker, text
  FROM talk JOIN firsts USING (root) WHERE dated AND f.inbound AND f.says AND r.says)"""
FOUND_SQL = f"WITH RECURSIVE {_TALK} SELECT episode_id, turn_no, tweet_id, speaker FROM told"
THREADS_SQL = f"WITH RECURSIVE {_TALK} SELECT episode_id, turn_no, speaker AS role, text FROM told"
SESSIONS_SQL = rf"""WITH {_MESSAGES}, d AS (SELECT * FROM m WHERE ts IS NOT NULL AND author IS NOT NULL),
b AS (SELECT parent AS id, min({{'ts': ts, 'id': id, 'author': author}}).author AS below FROM d WHERE parent IS NOT NULL GROUP BY 1),
p AS (SELECT d.*, lower(d.author) AS own, coalesce(nullif(d.mention, ''), CASE WHEN lower(a.author) <> lower(d.author) THEN lower(a.author) END, CASE WHEN lower(below) <> lower(d.author) THEN lower(below) END) AS partner FROM d LEFT JOIN d AS a ON a.id = d.parent LEFT JOIN b ON b.id = d.id),
c AS (SELECT *, CASE WHEN inbound THEN own || '|' || coalesce(partner, '') ELSE partner || '|' || own END AS channel FROM p WHERE inbound OR partner IS NOT NULL),
g AS (SELECT *, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY channel ORDER BY ts, id))::BIGINT AS gap FROM c),
h AS (SELECT CASE WHEN gap > 0 THEN floor(log2(gap::DOUBLE))::INT ELSE 0 END AS power, count(parent) AS replies, count(*) - count(parent) AS openings FROM g WHERE gap IS NOT NULL GROUP BY 1),
e AS (SELECT power, sum(replies) OVER () - sum(replies) OVER (ORDER BY power) + sum(openings) OVER (ORDER BY power) AS errors FROM h),
l AS (SELECT coalesce((SELECT 2 ** (power + 1) FROM e ORDER BY errors, power LIMIT 1), 0) AS lim),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= lim THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS session FROM g, l),
f AS (SELECT channel, session, min({{'ts': ts, 'id': id, 'inbound': inbound, 'says': says}}) AS f, min({{'ts': ts, 'id': id, 'author': author, 'says': says}}) FILTER (NOT inbound) AS r FROM s GROUP BY ALL)
SELECT r.author || '-' || f.id AS episode_id, row_number() OVER (PARTITION BY channel, session ORDER BY ts, s.id) AS turn_no, s.id AS tweet_id, CASE WHEN author = r.author THEN 'brand' ELSE 'customer' END AS speaker
FROM s JOIN f USING (channel, session) WHERE f.inbound AND f.says AND r.says"""
