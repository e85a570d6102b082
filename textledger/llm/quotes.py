"""Chat formatting by quotation linking.

Lines are parsed into quote level and content (prefix `>`, nested by repeats). A message's own text
is its lines of level 0, without "On ... wrote:" lines. Passages of each level, paragraphs as well as
single lines, are normalised (lower case, runs of letters and digits) and hashed. A quoted passage is
linked to its original, the first message of its conversation whose own text has that passage, if
that came before. A message replies to the original with the most quoted characters of the lowest
linked level (ties to the later message). Roots are found by pointer jumping, in about log2 of the
longest reply chain rounds, so a conversation in reply order is its rows by (root_turn, turn): threads
in the order of their first messages, parents before replies. DataFrame functions only.

Originals are a minimum for each (conversation, passage), pre-aggregated, so neither a conversation
with a third of all rows nor a passage that everyone repeats makes pairs or a large group; no
conversation is collected.

Defined results: a null text is empty; rows without conversation or turn are formatted and link with
nothing; a null role is "user"; repeated rows each give a row, rows that share conversation and turn
are one message when linked; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

PREFIX = r"^(?: ?>)+ ?"
WROTE = r"^(?:On|Am|Le|El) .* (?:wrote|schrieb|a écrit|escribió) ?:$"
BLANK = r"\n[ \t]*(?:\n[ \t]*)+"
NOT_WORD = r"[^\p{L}\p{Nd}]+"


def parsed(text: Column) -> Column:
    """An array of (level, content), one for each line."""

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, PREFIX, 0)
        level = F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.substring(x, F.length(prefix) + 1, F.length(x)).alias("content"))

    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(WROTE))
    return F.transform(kept, line)


def at_level(lines: Column, level: Column) -> Column:
    """The text of one level, other lines blank."""
    return F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["content"]).otherwise("")), "\n")


def own_text(lines: Column) -> Column:
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    return F.regexp_replace(F.regexp_replace(own, BLANK, "\n\n"), r"^\s+|\s+$", "")


def passages(text: Column) -> Column:
    """The distinct normalised paragraphs and lines."""
    parts = F.concat(F.split(text, BLANK), F.split(text, "\n"))
    normal = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.lower(x), NOT_WORD, " ")))
    return F.array_distinct(F.filter(normal, lambda x: x != ""))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, linked) of the messages (conv_id, turn, lines) that quote earlier ones."""
    known = messages.where("conv_id is not null and turn is not null")
    levels = F.array_distinct(F.transform("lines", lambda x: x["level"]))
    quoted = known.select("conv_id", "turn", "lines", F.explode(F.filter(levels, lambda x: x > 0)).alias("level"))
    quoted = quoted.select("conv_id", "turn", "level", F.explode(passages(at_level(F.col("lines"), F.col("level")))).alias("passage"))
    quoted = quoted.withColumn("hash", F.xxhash64("passage")).withColumn("size", F.length("passage"))
    quoted = written(quoted.select("conv_id", "turn", "level", "hash", "size").distinct(), "quoted")
    own = known.select("conv_id", "turn", F.explode(passages(at_level(F.col("lines"), F.lit(0)))).alias("passage"))
    own = own.select("conv_id", "turn", F.xxhash64("passage").alias("hash"))
    asked = quoted.select("conv_id", "hash").distinct()
    first = own.join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    links = quoted.join(first, ["conv_id", "hash"]).where("original < turn")
    by_original = links.groupBy("conv_id", "turn", "level", "original").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("up"), "size", "original")).alias("best")
    return by_original.groupBy("conv_id", "turn").agg(best, F.sum("n").alias("linked")).select(
        "conv_id", "turn", F.col("best.original").alias("reply_to"), "linked"
    )


def roots(links: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) for links (conv_id, turn, reply_to), each round doubling the reach."""
    now = written(links.select("conv_id", "turn", F.col("reply_to").alias("root_turn"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        moved = now.join(up, ["conv_id", "root_turn"], "left")
        after = written(
            moved.select(
                "conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved"),
            ),
            "roots",
        )
        now = after.drop("moved")
        if after.where("moved").isEmpty():
            return now


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Per message (conv_id, turn, role, text): its place in the reply order and its text without quotes."""
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), parsed(F.col("text")).alias("lines"))
    links = written(replies(rows.select("conv_id", "turn", "lines")), "links")
    places = links.join(roots(links), ["conv_id", "turn"])
    content = own_text(F.col("lines"))
    flat = rows.select(
        "conv_id",
        "turn",
        "role",
        content.alias("content"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("quoted_lines"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).cast("long").alias("max_level"),
    )
    return flat.join(places, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "content", "quoted_lines", "max_level", F.coalesce("linked", F.lit(0)).alias("linked"), "reply_to",
        F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def formatted(role: Column, content: Column) -> Column:
    """A message in chat markup."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("<|end|>\n"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reply_ordered(table(spark, sf_dir, "conversations"))
    return rows.withColumn("message", formatted(F.col("role"), F.col("content")))


OP7_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, 'user') AS role,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '^(?:On|Am|Le|El) .* (?:wrote|schrieb|a écrit|escribió) ?:$')) AS ls
  FROM conversations),
l AS (SELECT rid, conv_id, turn, i, ls[i] AS line, regexp_extract(ls[i], '^(?: ?>)+ ?') AS p
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM m)),
c AS (SELECT *, length(p) - length(replace(p, '>', '')) AS level, substr(line, length(p) + 1) AS content FROM l),
lv AS (SELECT DISTINCT rid, level FROM c UNION SELECT rid, 0 FROM m),
t AS (SELECT lv.rid, lv.level, string_agg(CASE WHEN c.level = lv.level THEN content ELSE '' END, chr(10) ORDER BY i) AS text
  FROM lv JOIN c USING (rid) GROUP BY ALL),
u AS (SELECT DISTINCT rid, level, trim(regexp_replace(lower(x), '[^\p{L}\p{Nd}]+', ' ', 'g')) AS x
  FROM (SELECT rid, level, unnest(list_concat(string_split_regex(text, '\n[ \t]*(?:\n[ \t]*)+'), string_split(text, chr(10)))) AS x FROM t)),
v AS (SELECT DISTINCT conv_id, turn, level, x FROM u JOIN m USING (rid) WHERE x <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
f AS (SELECT conv_id, x, min(turn) AS original FROM v WHERE level = 0 GROUP BY ALL),
k AS (SELECT v.conv_id, turn, level, original, sum(length(x)) AS size, count(*) AS n FROM v JOIN f USING (conv_id, x)
  WHERE level > 0 AND original < turn GROUP BY ALL),
r AS (SELECT conv_id, turn, sum(n)::BIGINT AS linked, first(original ORDER BY level, size DESC, original DESC) AS reply_to FROM k GROUP BY ALL),
w AS (SELECT conv_id, turn, reply_to AS root_turn, 1::BIGINT AS depth FROM r
  UNION ALL SELECT w.conv_id, w.turn, r.reply_to, w.depth + 1 FROM w JOIN r ON r.conv_id = w.conv_id AND r.turn = w.root_turn),
z AS (SELECT conv_id, turn, arg_max(root_turn, depth) AS root_turn, max(depth) AS depth FROM w GROUP BY ALL),
o AS (SELECT rid, coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (level = 0), '') AS own, count(*) FILTER (level > 0) AS quoted_lines,
    max(level) AS max_level FROM c GROUP BY rid),
q AS (SELECT m.rid, conv_id, turn, role, coalesce(regexp_replace(regexp_replace(own, '\n[ \t]*(?:\n[ \t]*)+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS content,
    coalesce(quoted_lines, 0)::BIGINT AS quoted_lines, coalesce(max_level, 0)::BIGINT AS max_level FROM m LEFT JOIN o USING (rid))
SELECT q.conv_id, q.turn, role, content, quoted_lines, max_level, coalesce(linked, 0)::BIGINT AS linked, reply_to,
  coalesce(root_turn, q.turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth,
  '<|' || role || '|>' || chr(10) || content || '<|end|>' || chr(10) AS message
FROM q LEFT JOIN r ON r.conv_id = q.conv_id AND r.turn = q.turn LEFT JOIN z ON z.conv_id = q.conv_id AND z.turn = q.turn"""
