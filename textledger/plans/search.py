"""Search queries over the documents' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import registered
from ..functions import text as T
from ..operators import search as S
from ..operators import stored_search
from ..operators.corpus import matches_globs
from ..operators.index_updates import FollowedIndex
from ..sources.tables import durable, file_versions, work_path
from .fixtures import FILES_V1, FILES_V2, LINES_V1, files_v1, files_v2, lines_of

QUERIES, ORACLES = {}, {}
#: Query lists: frequent and rare phrases, and ones that no trigram helps.
LITERALS = [(1, "the "), (2, "MIT License"), (3, "ation of"), (4, "Ing "), (5, "qui"), (6, "ung und"), (7, "no such line"), (8, "entre."), (9, "the"), (10, "and ou"), (11, "ΟΔΟΣ")]
SHORT = [(21, "q."), (22, "ß"), (23, "Th")]
REGEXES = [(31, "th(at|is|em) [a-z]+ing"), (32, "^Released under"), (33, "[0-9]{3}-[0-9]{4}"), (34, "(der|die|das) [a-z]*ung"), (35, "li?cense"), (36, "a.c.e"), (37, r"\p{L}+heit und"), (38, r"\QMIT L\E[i-k]cense")]
WORDS = [(41, "license MIT"), (42, "thation edition"), (43, "the and"), (44, "MitLicense eauxion"), (45, "und der die")]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def listed(spark, rows):
    return spark.createDataFrame(rows, "query_id long, text string")


def values(rows) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in rows) + ") AS q(query_id, pattern)"


def lines(spark, d):
    return lines_of(files_v1(spark, d))


BASE = f"{FILES_V1}, {LINES_V1}"
HITS = f"hits AS (SELECT query_id::BIGINT AS query_id, path, line_no::INT AS line_no, text FROM lines JOIN {values(LITERALS)} ON contains(text, pattern))"
TRI = "(SELECT path, (line_no - 1) // 256 AS chunk_no, unnest(list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))) AS tri FROM lines WHERE length(text) >= 3)"


_stored: dict[tuple, stored_search.Buckets] = {}


def stored(spark, d, name: str) -> stored_search.Buckets:
    """An index (trigrams or words), built once for each session and state of the documents' files."""
    key = (spark.sparkContext.applicationId, d, name, file_versions(spark, f"{d}/documents.parquet"))
    if key not in _stored:
        at = work_path(spark, f"search-{name}")
        if name == "trigrams":
            _stored[key] = stored_search.write_trigrams(S.chunks_of(files_v1(spark, d)), at)
        else:
            _stored[key] = stored_search.write_words(files_v1(spark, d), at)
    if _stored[key].spark is not spark:
        _stored[key] = stored_search.Buckets(spark, _stored[key].at, _stored[key].key)
    return _stored[key]


@query("build_trigram_index", f"WITH {BASE} SELECT DISTINCT tri, path, chunk_no::INT AS chunk_no FROM {TRI}")
def build_trigram_index(spark, d):
    return S.trigram_index(S.chunks_of(files_v1(spark, d)))


TOKENS = "(SELECT path, unnest(regexp_extract_all(content, '[\\p{L}\\p{Nd}]+')) AS w FROM {files})"
CAMEL = "list_filter(string_split(regexp_replace(regexp_replace(w, '([\\p{Ll}\\p{Nd}])(\\p{Lu})', '\\1|\\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1|\\2', 'g'), '|'), lambda x: x <> '')"


def word_sql(files: str) -> str:
    return f"""(SELECT path, unnest(CASE WHEN len(p) > 1 THEN list_concat([lower(w)], list_transform(p, lambda x: lower(x))) ELSE [lower(w)] END) AS token
  FROM (SELECT path, w, {CAMEL} AS p FROM {TOKENS.replace('{files}', files)}))"""


@query("build_word_index", f"WITH {FILES_V1} SELECT token, path, count(*) AS tf FROM {word_sql('files_v1')} GROUP BY ALL")
def build_word_index(spark, d):
    return S.word_index(files_v1(spark, d))


def changed(spark, d):
    """Paths whose content differs between the two snapshots or that only one has."""
    a, b = (f(spark, d).select("path", F.sha2("content", 256).alias("h")) for f in (files_v1, files_v2))
    both = a.withColumnRenamed("h", "old").join(b, "path", "full_outer").where("not (old <=> h)")
    return both.select("path")


@query("sync_trigram_index", f"WITH {FILES_V2}, {LINES_V1.replace('files_v1', 'files_v2')} SELECT DISTINCT tri, path, chunk_no::INT AS chunk_no FROM {TRI}")
def sync_trigram_index(spark, d):
    """The stored index with only the chunks that changed indexed anew."""
    now = S.chunks_of(files_v2(spark, d))
    index = stored(spark, d, "trigrams")
    touched = S.changed_chunks(index.chunks(), now)
    return S.replaced(index.postings(), S.trigram_index(now.join(touched, ["path", "chunk_no"], "left_semi")), touched)


@query(
    "search_after_update",
    f"WITH {FILES_V2}, {LINES_V1.replace('files_v1', 'files_v2')} SELECT query_id::BIGINT AS query_id, path, line_no::INT AS line_no, text FROM lines JOIN {values([*LITERALS, (12, 'inserted after ')])} ON contains(text, pattern)",
)
def search_after_update(spark, d):
    """Hits in the second snapshot, from the index of the first one and an update."""
    index = FollowedIndex.start(stored(spark, d, "trigrams"), files_v1(spark, d), work_path(spark, "search-updates"))
    index.update(files_v2(spark, d))
    return stored_search.search_literal(listed(spark, [*LITERALS, (12, "inserted after ")]), index)


@query("sync_word_index", f"WITH {FILES_V2} SELECT token, path, count(*) AS tf FROM {word_sql('files_v2')} GROUP BY ALL")
def sync_word_index(spark, d):
    touched = changed(spark, d)
    return S.replaced(stored(spark, d, "words").postings().drop("dl"), S.word_index(files_v2(spark, d).join(touched, "path", "left_semi")), touched)


def literal_hits(spark, d):
    return stored_search.search_literal(listed(spark, LITERALS), stored(spark, d, "trigrams"))


@query("search_literal", f"WITH {BASE}, {HITS} SELECT * FROM hits")
def search_literal(spark, d):
    return literal_hits(spark, d)


@query("search_scan", f"WITH {BASE} SELECT query_id::BIGINT AS query_id, path, line_no::INT AS line_no, text FROM lines JOIN {values(SHORT)} ON contains(text, pattern)")
def search_scan(spark, d):
    return S.search_scan(listed(spark, SHORT), lines(spark, d), S.literal_match())


@query("search_regex", f"WITH {BASE} SELECT query_id::BIGINT AS query_id, path, line_no::INT AS line_no, text FROM lines JOIN {values(REGEXES)} ON regexp_matches(text, pattern)")
def search_regex(spark, d):
    return stored_search.search_regex(listed(spark, REGEXES), REGEXES, stored(spark, d, "trigrams"))


@query(
    "search_batch_mixed",
    f"""WITH {BASE} SELECT query_id::BIGINT AS query_id, mode, path, line_no::INT AS line_no FROM (
  SELECT query_id, 'literal' AS mode, path, line_no FROM lines JOIN {values(LITERALS)} ON contains(text, pattern)
  UNION ALL SELECT query_id, 'scan', path, line_no FROM lines JOIN {values(SHORT)} ON contains(text, pattern)
  UNION ALL SELECT query_id, 'regex', path, line_no FROM lines JOIN {values(REGEXES)} ON regexp_matches(text, pattern))""",
)
def search_batch_mixed(spark, d):
    parts = {"literal": search_literal, "scan": search_scan, "regex": search_regex}
    out = None
    for mode, f in parts.items():
        rows = f(spark, d).select("query_id", F.lit(mode).alias("mode"), "path", "line_no")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("match_literal", f"WITH {BASE} SELECT path, line_no::INT AS line_no FROM lines WHERE contains(text, 'ation of')")
def match_literal(spark, d):
    return lines(spark, d).where(F.contains("text", F.lit("ation of"))).select("path", "line_no")


@query("match_regex", f"WITH {BASE} SELECT path, line_no::INT AS line_no FROM lines WHERE regexp_matches(text, '(der|die|das) [a-z]*ung')")
def match_regex(spark, d):
    return lines(spark, d).where(F.col("text").rlike("(der|die|das) [a-z]*ung")).select("path", "line_no")


@query("match_whole_word", f"WITH {FILES_V1} SELECT path, len(regexp_extract_all(content, '\\bthe\\b'))::BIGINT AS n FROM files_v1 WHERE starts_with(path, 'docs/src1/') AND ends_with(path, '.txt')")
def match_whole_word(spark, d):
    files = files_v1(spark, d).where("startswith(path, 'docs/src1/') and endswith(path, '.txt')")
    return files.select("path", F.regexp_count("content", F.lit(r"\bthe\b")).cast("long").alias("n"))


@query("topk_hits", f"WITH {BASE}, {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY path, line_no) AS rank, count(*) OVER (PARTITION BY query_id) AS n FROM hits) SELECT query_id, path, line_no, text, rank::INT AS rank, n > 20 AS more FROM r WHERE rank <= 20")
def topk_hits(spark, d):
    return S.top_hits(literal_hits(spark, d))


@query("search_summary", f"WITH {BASE}, {HITS} SELECT query_id, count(*) AS hits, count(DISTINCT path) AS files, CASE WHEN count(*) > 200 THEN '200+' ELSE count(*)::VARCHAR END AS label FROM hits GROUP BY query_id")
def search_summary(spark, d):
    return S.summary(literal_hits(spark, d))


CONTEXT = f"""{HITS},
ctx AS (SELECT DISTINCT f.query_id, l.path, l.line_no::INT AS line_no, l.text FROM hits f JOIN lines l ON f.path = l.path AND abs(l.line_no - f.line_no) <= 2
  WHERE NOT EXISTS (SELECT 1 FROM hits g WHERE g.query_id = f.query_id AND g.path = l.path AND g.line_no = l.line_no))"""


@query("hit_context", f"WITH {BASE}, {CONTEXT} SELECT * FROM ctx")
def hit_context(spark, d):
    return S.context(durable(literal_hits(spark, d)), lines(spark, d), 2)


@query(
    "context_groups",
    f"""WITH {BASE}, {CONTEXT}, a AS (SELECT query_id, path, line_no, 1 AS hit FROM hits UNION ALL SELECT query_id, path, line_no, 0 FROM ctx),
g AS (SELECT *, coalesce(line_no - lag(line_no) OVER w > 1, false)::INT AS gap FROM a WINDOW w AS (PARTITION BY query_id, path ORDER BY line_no)),
h AS (SELECT *, sum(gap) OVER (PARTITION BY query_id, path ORDER BY line_no) AS group_no FROM g)
SELECT query_id, path, group_no::BIGINT AS group_no, min(line_no) AS first_line, max(line_no) AS last_line, sum(hit)::BIGINT AS hits FROM h GROUP BY ALL""",
)
def context_groups(spark, d):
    hits = durable(literal_hits(spark, d))
    return S.groups(hits, S.context(hits, lines(spark, d), 2))


@query(
    "dnf_candidates",
    f"WITH {BASE}, c AS (SELECT path, (line_no - 1) // 256 AS chunk_no, string_agg(lower(text), chr(10)) AS t FROM lines GROUP BY ALL) SELECT path, chunk_no::INT AS chunk_no FROM c WHERE contains(t, 'lic') AND contains(t, 'ice') AND contains(t, 'cen') AND contains(t, 'ens') OR contains(t, 'mit') AND contains(t, 'it ')",
)
def dnf_candidates(spark, d):
    """Chunks of either clause: all trigrams of "licens", or all of "mit "."""
    needles = spark.createDataFrame([(1, 0, "licens"), (1, 1, "mit ")], "query_id long, clause int, literal string")
    return stored_search.candidates(needles, stored(spark, d, "trigrams")).select("path", "chunk_no").distinct()


TERMS = f"""tw AS (SELECT query_id, unnest(regexp_extract_all(pattern, '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM {values(WORDS)}),
tp AS (SELECT query_id, lower(w) AS whole, list_transform({CAMEL}, lambda x: lower(x)) AS parts FROM tw),
post AS (SELECT token, path, count(*) AS tf FROM {word_sql('files_v1')} GROUP BY ALL),
st AS (SELECT f.path, coalesce(sum(tf), 0)::BIGINT AS dl FROM files_v1 f LEFT JOIN post USING (path) GROUP BY f.path),
ph AS (SELECT query_id, whole AS term, 'whole' AS kind, whole AS token FROM tp UNION SELECT query_id, whole, 'part', unnest(parts) FROM tp WHERE len(parts) > 1),
sel AS (SELECT DISTINCT query_id, path FROM (SELECT ph.query_id, term, path, bool_or(kind = 'whole') AS w, count(DISTINCT token) FILTER (kind = 'part') AS have
    FROM ph JOIN post USING (token) GROUP BY ALL) h LEFT JOIN (SELECT query_id, term, count(DISTINCT token) AS need FROM ph WHERE kind = 'part' GROUP BY ALL) n USING (query_id, term) WHERE w OR have = need),
idf AS (SELECT token, greatest(ln(((SELECT count(*) FROM st) - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY token)),
sc AS (SELECT query_id::BIGINT AS query_id, path, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM st)))), 6) AS score
  FROM (SELECT DISTINCT query_id, token FROM ph) JOIN post USING (token) JOIN sel USING (query_id, path) JOIN idf USING (token) JOIN st USING (path) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path)::INT AS rank FROM sc)"""


def scores(spark, d):
    return stored_search.bm25(listed(spark, WORDS), stored(spark, d, "words"))


@query("search_bm25", f"WITH {FILES_V1}, {TERMS} SELECT * FROM sc")
def search_bm25(spark, d):
    return scores(spark, d)


@query("topk_words", f"WITH {FILES_V1}, {TERMS} SELECT query_id, path, score, rank FROM rk WHERE rank <= 10")
def topk_words(spark, d):
    return S.top_words(scores(spark, d), 10)


@query("search_bm25_within", f"WITH {FILES_V1}, {TERMS} SELECT * FROM sc WHERE regexp_matches(path, '^docs/src1[^/]*(/.*)?$')")
def search_bm25_within(spark, d):
    """The ranked search with a glob on paths."""
    return stored_search.bm25(listed(spark, WORDS), stored(spark, d, "words"), matches_globs(F.col("path"), ["docs/src1*"]))


@query("search_literal_within", f"WITH {BASE}, {HITS} SELECT * FROM hits WHERE regexp_matches(path, '^docs/[^/]*/en(/.*)?$')")
def search_literal_within(spark, d):
    return stored_search.search_literal(listed(spark, LITERALS), stored(spark, d, "trigrams"), matches_globs(F.col("path"), ["docs/*/en"]))


@query("word_function", f"WITH {FILES_V1} SELECT token, count(*) AS n FROM {word_sql('files_v1')} GROUP BY token")
def word_function(spark, d):
    """Words counted in SQL with the registered function."""
    registered.register(spark)
    return spark.sql("SELECT token, count(*) AS n FROM (SELECT explode(words) AS token FROM (SELECT words_text(content) AS words FROM {files})) GROUP BY token", files=files_v1(spark, d))


LINE_SCORES = f"""lw AS (SELECT path, line_no, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM lines),
lp AS (SELECT path, line_no, list_distinct(list(lower(w))) AS plain, list_distinct(list_concat(list(lower(w)), flatten(list(list_transform({CAMEL}, lambda x: lower(x)))))) AS toks FROM lw GROUP BY ALL),
ls AS (SELECT t.query_id::BIGINT AS query_id, path, line_no::INT AS line_no, sum(CASE WHEN list_contains(plain, whole) THEN 2 WHEN len(parts) > 1 AND list_has_all(toks, parts) THEN 1 ELSE 0 END)::INT AS line_score
  FROM lp, tp t GROUP BY ALL)"""


@query("line_score", f"WITH {BASE}, {TERMS}, {LINE_SCORES} SELECT * FROM ls WHERE line_score > 0")
def line_score(spark, d):
    terms = listed(spark, WORDS).select("query_id", T.query_terms(F.col("text")).alias("terms"))
    rows = S.worded_lines(lines(spark, d)).crossJoin(F.broadcast(terms))  # a fixed list of five queries
    return rows.select("query_id", "path", "line_no", T.words_score(F.col("plain"), F.col("words"), F.col("terms")).alias("line_score")).where("line_score > 0")


BEST = f"""{TERMS}, {LINE_SCORES}, bl AS (SELECT * FROM (SELECT rk.query_id, rk.path, rank, line_no, line_score,
  row_number() OVER (PARTITION BY rk.query_id, rk.path ORDER BY line_score DESC, line_no) AS r FROM rk JOIN ls USING (query_id, path) WHERE rank <= 10 AND line_score > 0) WHERE r <= 3)"""


@query("best_lines", f"WITH {BASE}, {BEST} SELECT query_id, path, rank, line_no, line_score FROM bl")
def best_lines(spark, d):
    return S.best_lines(topk_words(spark, d), lines(spark, d), listed(spark, WORDS))


@query(
    "ranked_budget",
    f"""WITH {BASE}, {BEST}, n AS (SELECT query_id, path, rank, (SELECT count(*) FROM bl WHERE bl.query_id = rk.query_id AND bl.path = rk.path) AS n FROM rk WHERE rank <= 10),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM n)
SELECT query_id, path, rank, least(n, 12 - spent)::BIGINT AS shown, bool_or(spent >= 12) OVER (PARTITION BY query_id) AS more FROM s QUALIFY n > 0 AND spent < 12""",
)
def ranked_budget(spark, d):
    ranked = durable(topk_words(spark, d))
    return S.ranked_budget(ranked, S.best_lines(ranked, lines(spark, d), listed(spark, WORDS)), 12)
