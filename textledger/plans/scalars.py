"""Queries over the scalar functions and the simple filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .fixtures import FILES_STYLED, FILES_V1, FILES_V2, LINES_V1, OUTCOMES, CALLS, calls, files_styled, files_v1, files_v2, lines_of, table

SHA = "sha256(content)"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("classify_text", f"WITH {FILES_STYLED} SELECT path, CASE WHEN contains(content, chr(0)) THEN 'binary' ELSE 'text' END AS kind FROM files_styled")
def classify_text(spark, d):
    return files_styled(spark, d).select("path", F.when(T.is_text(F.col("content")), "text").otherwise("binary").alias("kind"))


SPLIT = """CASE WHEN b = '' THEN [] ELSE list_concat(list_transform(l0[1:len(l0)-1], lambda x: regexp_replace(x, '\\r$', '')),
  CASE WHEN l0[len(l0)] = '' THEN [] ELSE [l0[len(l0)]] END) END"""
STYLED_LINES = f"""{FILES_STYLED}, sl AS (SELECT path, content, {SPLIT} AS ls FROM (SELECT *, string_split(b, chr(10)) AS l0 FROM
  (SELECT path, content, CASE WHEN starts_with(content, chr(65279)) THEN substr(content, 2) ELSE content END AS b FROM files_styled)))"""


@query("split_lines", f"WITH {STYLED_LINES} SELECT path, n::INT AS line_no, ls[n] AS text FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS n FROM sl)")
def split_lines(spark, d):
    return lines_of(files_styled(spark, d))


FORMAT = """CASE WHEN crlf * 2 > n THEN 'crlf' ELSE 'lf' END AS eol, crlf > 0 AND crlf < n AS mixed,
  starts_with(content, chr(65279)) AS bom, ends_with(content, chr(10)) AS final_newline"""
COUNTED = """(SELECT path, content, length(content) - length(replace(content, chr(10), '')) AS n,
  (length(content) - length(replace(content, chr(13) || chr(10), ''))) / 2 AS crlf FROM files_styled)"""


@query("line_format", f"WITH {FILES_STYLED} SELECT path, {FORMAT} FROM {COUNTED}")
def line_format(spark, d):
    return files_styled(spark, d).select("path", T.line_format(F.col("content")).alias("f")).select("path", "f.*")


@query("join_lines", f"WITH {FILES_STYLED} SELECT path, sha256(content) AS hash, true AS same FROM files_styled")
def join_lines(spark, d):
    files = files_styled(spark, d)
    form = T.line_format(F.col("content"))
    joined = files.select("path", "content", T.join_lines(T.split_lines(F.col("content")), form).alias("joined"))
    return joined.select("path", F.sha2("joined", 256).alias("hash"), (F.col("joined") == F.col("content")).alias("same"))


@query("content_version", f"WITH {FILES_V1} SELECT path, substr(sha256(content), 1, 6) AS version, true AS valid FROM files_v1")
def content_version(spark, d):
    v = files_v1(spark, d).select("path", T.content_version(F.col("content")).alias("version"))
    return v.withColumn("valid", T.is_version(F.col("version")))


B62 = T.BASE62
HASH_SQL = "(('0x' || substr(sha256(text), 1, 12))::BIGINT % 238328)"
LINE_HASH = f"substr('{B62}', ({HASH_SQL} // 3844) % 62 + 1, 1) || substr('{B62}', ({HASH_SQL} // 62) % 62 + 1, 1) || substr('{B62}', {HASH_SQL} % 62 + 1, 1)"


@query("line_hash", f"WITH {FILES_V1}, {LINES_V1} SELECT path, line_no::INT AS line_no, {LINE_HASH} AS line_hash FROM lines")
def line_hash(spark, d):
    return lines_of(files_v1(spark, d)).select("path", "line_no", T.line_hash(F.col("text")).alias("line_hash"))


ANCHORS = """(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN doc_id || ':aB3' WHEN 2 THEN 'x' || doc_id WHEN 3 THEN doc_id || ':aB' ELSE '' END AS a FROM documents)"""


@query(
    "anchor_parse",
    f"""SELECT doc_id, a, CASE WHEN ok AND n > 0 THEN n END AS line_no, CASE WHEN ok AND n > 0 AND contains(a, ':') THEN string_split(a, ':')[2] END AS line_hash,
  CASE WHEN a = '' THEN 'empty' WHEN NOT ok THEN 'malformed' WHEN n <= 0 THEN 'line must be at least 1' END AS reason
FROM (SELECT *, regexp_full_match(a, '[0-9]+(:[0-9A-Za-z]{{3}})?') AS ok, TRY_CAST(string_split(a, ':')[1] AS INT) AS n FROM {ANCHORS})""",
)
def anchor_parse(spark, d):
    i = F.col("doc_id").cast("string")
    m = F.col("doc_id") % 5
    a = F.when(m == 0, i).when(m == 1, F.concat(i, F.lit(":aB3"))).when(m == 2, F.concat(F.lit("x"), i)).when(m == 3, F.concat(i, F.lit(":aB"))).otherwise("")
    return table(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", "a", T.anchor(F.col("a")).alias("p")).select("doc_id", "a", "p.*")


@query(
    "ranges_text",
    """SELECT l_orderkey, string_agg(CASE WHEN e < s THEN s || '(del)' WHEN e = s THEN s::VARCHAR ELSE s || '-' || e END, ',' ORDER BY s, e) AS ranges
FROM (SELECT l_orderkey, l_partkey AS s, l_partkey + l_suppkey % 4 - 1 AS e FROM lineitem) GROUP BY l_orderkey""",
)
def ranges_text(spark, d):
    r = F.struct(F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_suppkey") % 4 - 1).alias("end"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(r)).alias("r"))
    return rows.select("l_orderkey", T.ranges_text(F.col("r")).alias("ranges"))


@query("cut_text", f"WITH {FILES_V1}, {LINES_V1} SELECT path, line_no::INT AS line_no, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS text FROM lines")
def cut_text(spark, d):
    return lines_of(files_v1(spark, d)).select("path", "line_no", T.cut_text(F.col("text"), 200).alias("text"))


@query(
    "format_size",
    """SELECT event_id, n, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1f', floor(n * 10 / 1024.0::DOUBLE + 0.5) / 10) || 'K'
  WHEN n < 1073741824 THEN printf('%.1f', floor(n * 10 / 1048576.0::DOUBLE + 0.5) / 10) || 'M' ELSE printf('%.1f', floor(n * 10 / 1073741824.0::DOUBLE + 0.5) / 10) || 'G' END AS size
FROM (SELECT event_id, event_id * event_id * 37 AS n FROM events)""",
)
def format_size(spark, d):
    n = F.col("event_id") * F.col("event_id") * 37
    return table(spark, d, "events").select("event_id", n.alias("n")).withColumn("size", T.format_size(F.col("n")))


@query(
    "common_affix",
    f"""WITH {FILES_V1}, {FILES_V2}, p AS (SELECT path, string_split(a.content, chr(10)) AS x, string_split(b.content, chr(10)) AS y
  FROM files_v1 a JOIN files_v2 b USING (path) WHERE a.content <> b.content),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i])) - 1, least(len(x), len(y))) AS prefix FROM p)
SELECT path, prefix::INT AS prefix, coalesce(list_min(list_filter(range(1, least(len(x), len(y)) - prefix + 1), lambda i: x[len(x)+1-i] <> y[len(y)+1-i])) - 1,
  least(len(x), len(y)) - prefix)::INT AS suffix FROM q""",
)
def common_affix(spark, d):
    old, new = files_v1(spark, d).select("path", F.col("content").alias("old")), files_v2(spark, d)
    both = old.join(new, "path").where("old <> content")
    affix = T.common_affix(F.split("old", "\n", -1), F.split("content", "\n", -1))
    return both.select("path", affix.alias("a")).select("path", "a.*")


@query(
    "trigrams",
    "SELECT user_id, event_type, list_sort(list_distinct(list_transform(range(1, length(event_type) - 1), lambda i: substr(event_type, i, 3)))) AS trigrams FROM (SELECT DISTINCT user_id, event_type FROM events)",
)
def trigrams(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type").distinct()
    return rows.withColumn("trigrams", F.array_sort(T.trigrams(F.col("event_type"))))


@query("word_tokens", f"WITH {FILES_V1} SELECT path, t.w AS word, count(*) AS n FROM files_v1, unnest(regexp_extract_all(content, '[\\p{{L}}\\p{{Nd}}]+')) AS t(w) GROUP BY ALL")
def word_tokens(spark, d):
    words = files_v1(spark, d).select("path", F.explode(T.word_tokens(F.col("content"))).alias("word"))
    return words.groupBy("path", "word").agg(F.count("*").alias("n"))


NAMES = "(SELECT p_partkey, 'get' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || 'HTTPServer' || p_partkey AS name FROM part)"
PARTS_SQL = "list_filter(string_split(regexp_replace(regexp_replace(name, '([\\p{Ll}\\p{Nd}])(\\p{Lu})', '\\1|\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1|\\2', 'g'), '|'), lambda x: x <> '')"


@query("camel_parts", f"SELECT p_partkey, {PARTS_SQL} AS parts FROM (SELECT p_partkey, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS name FROM {NAMES})")
def camel_parts(spark, d):
    name = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.substring(F.col("p_name"), F.lit(2), F.length("p_name")), F.lit("HTTPServer"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.camel_parts(F.regexp_replace(name, "[^A-Za-z0-9]", "")).alias("parts"))


@query(
    "words_text",
    f"""SELECT p_partkey, CASE WHEN len(p) > 1 THEN list_concat([lower(name)], list_transform(p, lambda x: lower(x))) ELSE [lower(name)] END AS words
FROM (SELECT p_partkey, name, {PARTS_SQL} AS p FROM (SELECT p_partkey, regexp_replace(name, '[^A-Za-z0-9]', '', 'g') AS name FROM {NAMES}))""",
)
def words_text(spark, d):
    name = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.substring(F.col("p_name"), F.lit(2), F.length("p_name")), F.lit("HTTPServer"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", T.words_text(F.regexp_replace(name, "[^A-Za-z0-9]", "")).alias("words"))


@query("outcome_code", f"WITH {CALLS} SELECT call_id, outcome, CASE outcome {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in OUTCOMES.items())} END AS exit_code, outcome = 'ok' AS success FROM calls")
def outcome_code(spark, d):
    codes = F.create_map(*[x for k, v in OUTCOMES.items() for x in (F.lit(k), F.lit(v))])
    return calls(spark, d).select("call_id", "outcome", codes[F.col("outcome")].alias("exit_code"), (F.col("outcome") == "ok").alias("success"))
