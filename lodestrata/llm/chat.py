"""Chat formatting by quotation linking, with DataFrame functions only.

Lines that begin with ``>`` marks are quotes; the number of marks is their level. Adjoining lines of one level form
a passage. A passage, normalised (lower case, white space as single spaces) and hashed, is looked up among the
units of the conversation's messages: whole unquoted bodies, their paragraphs, and their lines. It comes
from the latest earlier turn that has it; a passage that is no unit as a whole goes by its longest line. A
message replies to the turn its shallowest linked passages come from, the latest of them. Messages without a
linked quote start a thread; following replies up gives each message its thread's first turn. Conversations
are returned thread by thread, turns in order, without quotes and the lines that announce them.

Passages meet candidate messages in one window per (conversation, hash) and never as pairs, and the final order
is a range sort, so a conversation with a third of all rows spreads over all tasks.

Defined cases: a null text is an empty message with an empty body; messages with a null conv_id or turn link
nothing and stand as their own thread (root_turn is turn). Repeated rows are kept, each with the same result. A
null role is written as ``unknown``. A very long text is split into lines within its row, and its passages are linked like any
others. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.storage import plain, stored, table

_QUOTED = r"(?<![^\n])[ \t]*+>[^\n]*+"
_ANNOUNCED = r"(?<![^\n])[^\n>]*(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*+:[ \t]*+\n(?=[ \t]*+>)"


def level(line: Column) -> Column:
    """Number of ``>`` marks that a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[ \t]*+(?:>[ \t]*+)*+", 0), r"[^>]", ""))


def content(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t]*+(?:>[ \t]*+)*+", "")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x00-\x20]++", " "))


def body(text: Column) -> Column:
    """A message's text without quotes and their announcements."""
    bare = F.regexp_replace(F.regexp_replace(text, _ANNOUNCED, ""), _QUOTED + r"(?:\n|\z)", "")
    return F.regexp_replace(bare, r"^[\x20\t\n\r]++|[\x20\t\n\r]++\z", "")


def messages(conversations: DataFrame) -> DataFrame:
    """The conversations' rows with body, n_quoted_lines and max_level."""
    m = plain(conversations, "conv_id", "turn", "role", "text").withColumn("text", F.coalesce("text", F.lit("")))
    quoted = F.regexp_extract_all("text", F.lit(_QUOTED), F.lit(0))
    split = m.select("*", F.when(F.col("text").contains(">"), quoted).otherwise(F.array().cast("array<string>")).alias("quoted"))
    return split.select(
        "conv_id", "turn", "role", "text",
        F.when(F.size("quoted") > 0, body(F.col("text"))).otherwise(F.regexp_replace("text", r"^[\x20\t\n\r]++|[\x20\t\n\r]++\z", "")).alias("body"),
        F.size("quoted").cast("long").alias("n_quoted_lines"),
        F.coalesce(F.array_max(F.transform("quoted", level)), F.lit(0)).cast("long").alias("max_level"),
    )


def passages(found: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, whole (hash), line (hash of the longest line) of quotes in ``messages()``."""
    quoting = found.where("n_quoted_lines > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.md5("text").alias("message"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.select("conv_id", "turn", "message", "at", level(F.col("line")).alias("level"), content(F.col("line")).alias("content"))
    order = Window.partitionBy("conv_id", "turn", "message").orderBy("at")
    begins = (F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(0))).cast("int")
    runs = lines.withColumn("passage", F.sum(begins).over(order)).where("level > 0")
    joined = runs.groupBy("conv_id", "turn", "message", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("at", "content"))).alias("lines"))
    text = normalised(F.array_join(F.transform("lines", lambda x: x["content"]), " "))
    longest = F.array_max(F.transform("lines", lambda x: F.struct(F.length(normalised(x["content"])).alias("n"), normalised(x["content"]).alias("text"))))["text"]
    return joined.select("conv_id", "turn", "passage", "level", text.alias("whole"), longest.alias("line")).where("whole != ''").select("conv_id", "turn", "passage", "level", F.md5("whole").alias("whole"), F.md5("line").alias("line"))


def links(found: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, origin (the turn that the passage is from) of linked passages."""
    quotes = passages(found)
    asked = quotes.select("conv_id", "turn", "passage", "level", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("whole").alias("hash")), F.struct(F.lit(1).alias("rank"), F.col("line").alias("hash")))).alias("key"))
    asked = stored(asked.select("conv_id", "turn", "passage", "level", "key.rank", "key.hash").distinct(), "quotes")
    pieces = F.concat(F.array("body"), F.split("body", r"\n[ \t]*+\n"), F.split("body", "\n"))
    units = found.where("conv_id is not null and turn is not null").join(asked.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(F.transform(pieces, normalised))).alias("unit"))
    units = units.where("unit != ''").select("conv_id", "turn", F.md5("unit").alias("hash")).join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    both = asked.withColumn("source", F.lit(None).cast("long")).unionByName(units.distinct().withColumn("source", F.col("turn").cast("long")), allowMissingColumns=True)
    earlier = Window.partitionBy("conv_id", "hash").orderBy(F.col("turn").cast("long")).rangeBetween(Window.unboundedPreceding, -1)
    linked = both.withColumn("origin", F.max("source").over(earlier)).where("rank is not null and origin is not null")
    best = linked.groupBy("conv_id", "turn", "passage", "level").agg(F.min(F.struct("rank", "origin"))["origin"].alias("origin"))
    return best


def threads(linked: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, root_turn, reply_depth of messages that reply: parents by link, roots by doubling."""
    shallow = linked.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("origin"))).alias("x"))
    parent = stored(shallow.select("conv_id", F.col("turn").cast("long").alias("turn"), (-F.col("x.origin")).alias("reply_to"), (-F.col("x.origin")).alias("root_turn"), F.lit(1).cast("long").alias("reply_depth")), "threads")
    while True:
        above = parent.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("higher"), F.col("reply_depth").alias("steps"))
        if parent.join(above, ["conv_id", "root_turn"], "left_semi").isEmpty():
            return parent
        joined = parent.join(above, ["conv_id", "root_turn"], "left")
        parent = stored(joined.select("conv_id", "turn", "reply_to", F.coalesce("higher", "root_turn").alias("root_turn"), (F.col("reply_depth") + F.coalesce("steps", F.lit(0))).alias("reply_depth")), "threads", replaces=parent)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Messages in reply order: conv_id, root_turn, turn, role, reply_to, reply_depth, n_quoted_lines, max_level, body, message."""
    found = messages(conversations)
    replies = threads(links(found)).withColumnRenamed("turn", "at")
    joined = found.join(replies.withColumnRenamed("conv_id", "conv"), F.expr("conv_id = conv and turn = at"), "left")
    return joined.select(
        "conv_id",
        F.coalesce("root_turn", F.col("turn").cast("long")).alias("root_turn"),
        "turn",
        "role",
        "reply_to",
        F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
        "n_quoted_lines",
        "max_level",
        "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "body", F.lit("\n")).alias("message"),
    ).orderBy("conv_id", "root_turn", "turn", "role", "body")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (
  SELECT rid, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM m),
v AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)*'), '[^>]', '', 'g')) AS lv, regexp_replace(line, '^[ \t]*(?:>[ \t]*)*', '') AS content FROM l),
a AS (
  SELECT *, lv = 0 AND NOT contains(line, '>') AND regexp_matches(line, '(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') AND coalesce(lead(lv) OVER w, 0) > 0 AS announced,
         (lv != coalesce(lag(lv) OVER w, 0))::INTEGER AS begins FROM v WINDOW w AS (PARTITION BY rid ORDER BY pos)),
f AS (
  SELECT m.rid, conv_id, turn, role, trim(coalesce(b, ''), E' \t\n\r') AS body, nq AS n_quoted_lines, ml::BIGINT AS max_level
  FROM m JOIN (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (lv = 0 AND NOT announced) AS b, count(*) FILTER (lv > 0) AS nq, max(lv) AS ml FROM a GROUP BY rid) USING (rid)),
r AS (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY pos) AS passage FROM a),
q AS (
  SELECT DISTINCT conv_id, turn, passage, lv, trim(regexp_replace(lower(string_agg(content, ' ' ORDER BY pos)), '[\x00-\x20]+', ' ', 'g')) AS whole,
         max(struct_pack(n := length(trim(regexp_replace(lower(content), '[\x00-\x20]+', ' ', 'g'))), t := trim(regexp_replace(lower(content), '[\x00-\x20]+', ' ', 'g')))).t AS longest
  FROM r WHERE lv > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY rid, conv_id, turn, passage, lv),
k AS (
  SELECT conv_id, turn, passage, lv, 0 AS rank, whole AS unit FROM q WHERE whole != '' UNION ALL SELECT conv_id, turn, passage, lv, 1, longest FROM q WHERE whole != ''),
u AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(x), '[\x00-\x20]+', ' ', 'g')) AS unit
  FROM (SELECT conv_id, turn, unnest(list_concat([body], string_split_regex(body, '\n[ \t]*\n'), string_split(body, chr(10)))) AS x FROM f)),
o AS (SELECT k.conv_id, k.turn, passage, lv, rank, max(u.turn) AS origin FROM k JOIN u ON k.conv_id = u.conv_id AND k.unit = u.unit AND u.turn < k.turn GROUP BY ALL),
best AS (SELECT conv_id, turn, lv, arg_min(origin, rank) AS origin FROM o GROUP BY conv_id, turn, passage, lv),
parent AS (SELECT conv_id, turn, max(origin) AS reply_to FROM best b WHERE lv = (SELECT min(lv) FROM best c WHERE c.conv_id = b.conv_id AND c.turn = b.turn) GROUP BY conv_id, turn),
t AS (
  SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM parent
  UNION ALL SELECT t.conv_id, t.turn, p.reply_to, depth + 1 FROM t JOIN parent p ON t.conv_id = p.conv_id AND t.root = p.turn),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM t GROUP BY conv_id, turn)
SELECT f.conv_id, coalesce(top.root, f.turn) AS root_turn, f.turn, role, reply_to, coalesce(depth, 0)::BIGINT AS reply_depth, n_quoted_lines, max_level, body,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) AS message
FROM f LEFT JOIN parent USING (conv_id, turn) LEFT JOIN top ON f.conv_id = top.conv_id AND f.turn = top.turn
"""
