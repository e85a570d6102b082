"""Batch search: trigram postings pick candidate chunks, lines are verified exactly.

Many queries are one table (query_id, mode, text). Files are kept as chunks (path, chunk_no, lines) of
256 lines, postings are (tri, path, chunk_no). A query's rarest trigrams by document frequency are
joined, the rest are left to the exact check, so a frequent trigram's long posting list isn't read for
queries that have a rarer one; only candidate chunks are taken apart into lines.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import literals
from ..functions import text as T
from ..sources.tables import durable

CHUNK = 256
RAREST = 4
K1, B = 1.2, 0.75
HITS, MOST_HITS, BEST = 20, 200, 3
#: Most queries that are sent to all tasks at once.
BLOCK = 10_000
#: Characters of text from which trigrams, or words, are taken at once.
PIECE, WORDS_PIECE = 1 << 20, 1 << 23
#: Most hashes of changed files or chunks that are sent to all tasks: some 64 MB.
MOST_CHANGED = 2_000_000


def chunks_of(files: DataFrame) -> DataFrame:
    """(path, chunk_no, lines) of files (path, content); files without lines have none."""
    rows = files.select("path", T.split_lines(F.col("content")).alias("all"))
    last = F.floor((F.size("all") - 1) / CHUNK).cast("int")
    parts = F.when(F.size("all") > 0, F.transform(F.sequence(F.lit(0), last), lambda c: F.slice("all", c * CHUNK + 1, F.lit(CHUNK))))
    return rows.select("path", F.posexplode(parts).alias("chunk_no", "lines"))


def first_line(*places: str) -> Column:
    """The place of a chunk's first line, from 0: the first of places that isn't null, else by its number."""
    return F.coalesce(*places, F.col("chunk_no") * CHUNK)


def sent(rows: DataFrame) -> DataFrame:
    """rows (of queries) sent to all tasks, if they are at most BLOCK: a query or a word may have a large part of all hits, which a shuffle would put into one task."""
    return F.broadcast(rows) if rows.limit(BLOCK + 1).count() <= BLOCK else rows


def worded_lines(lines: DataFrame) -> DataFrame:
    """(path, line_no, plain, words) of lines, for T.words_score."""
    words = lines.select("path", "line_no", "text", T.words_text(F.col("text")).alias("words"))
    return words.select("path", "line_no", F.when(F.col("text").rlike(T.HUMP), T.plain_words(F.col("text"))).otherwise(F.col("words")).alias("plain"), "words")


def lines_in(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep, path, line_no, text) of chunks; a chunk that has moved or first begins there."""
    start = first_line(*[c for c in ("moved", "first") if c in chunks.columns])
    rows = chunks.select(*keep, "path", start.alias("start"), F.posexplode("lines").alias("i", "text"))
    return rows.select(*keep, "path", (F.col("start") + F.col("i") + 1).alias("line_no"), "text")


def pieces(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and end of runs of rows that have about so many characters together, of rows of these sizes."""
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1
        yield at, min(end, len(size))
        at = end


def grams_of(texts: list[str], folds: dict[str, str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Trigrams of the texts' lines, how many texts before each one's have any, and these texts; folds: characters that lower-casing changes."""
    # Each text ends with a line end, and nothing over one is a trigram.
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used, code = np.unique(codes, return_inverse=True)
    low = [folds.get(c, c) for c in map(chr, used.tolist())]
    names = sorted(set(low))
    place = {c: k for k, c in enumerate(names)}
    letter = np.array([place[c] for c in low], np.int64)[code]
    end, n, many = codes == 10, len(names), len(texts)
    which = np.repeat(np.arange(many), [len(t) + 1 for t in texts])
    inside = ~(end[:-2] | end[1:-1] | end[2:])
    keys = (((letter[:-2] * n + letter[1:-1]) * n + letter[2:]) * many + which[:-2])[inside]
    keys.sort()
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    gram, which = np.divmod(keys, many)
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[first]
    spell = pa.array(names, pa.string())
    tris = pc.binary_join_element_wise(*[spell.take(pa.array(k % n)) for k in (gram // (n * n), gram // n, gram)], "")
    if any(len(c) > 1 for c in names) and len(again := tris.dictionary_encode().dictionary) < len(tris):  # two spellings of one trigram
        key = np.unique(pc.index_in(tris, again).to_numpy().astype(np.int64)[np.repeat(np.arange(len(first)), np.diff(first, append=len(which)))] * many + which)
        gram, which = np.divmod(key, many)
        tris, first = again, np.flatnonzero(np.diff(gram, prepend=-1))
    return tris, np.append(first, len(which)), which


def trigram_lists(chunks: DataFrame) -> DataFrame:
    """(tri, spots): trigrams with the chunks (path, chunk_no) of some that have them, each once: a row for each trigram of about PIECE characters."""
    return _trigrams(chunks, True)


def trigram_index(chunks: DataFrame) -> DataFrame:
    """(tri, path, chunk_no), each once. A chunk's trigrams are made distinct where it is read, so nothing is shuffled."""
    return _trigrams(chunks, False)


def _trigrams(chunks: DataFrame, lists: bool) -> DataFrame:
    folds = T.folds(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, chunk_no = batch.column(0), batch.column(1)
            texts = pc.binary_join(batch.column(2), "\n").cast(pa.binary())
            for at, end in pieces(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), PIECE):
                tris, first, which = grams_of([(t or b"").decode("utf-8", "replace") for t in texts.slice(at, end - at).to_pylist()], folds)
                rows = pa.array(which + at)
                if lists:
                    spots = pa.StructArray.from_arrays([path.take(rows), chunk_no.take(rows)], ["path", "chunk_no"])
                    yield pa.RecordBatch.from_arrays([tris, pa.ListArray.from_arrays(pa.array(first, pa.int32()), spots)], ["tri", "spots"])
                else:
                    each = tris.take(pa.array(np.repeat(np.arange(len(tris)), np.diff(first))))
                    yield pa.RecordBatch.from_arrays([each, path.take(rows), chunk_no.take(rows)], ["tri", "path", "chunk_no"])

    return chunks.select("path", "chunk_no", "lines").mapInArrow(run, "tri string, spots array<struct<path:string,chunk_no:int>>" if lists else "tri string, path string, chunk_no int")


def _words(files: DataFrame, lists: bool) -> DataFrame:
    """The words of files (path, content) with their counts tf and the file's number of words dl: a row each, or lists of files."""
    folds, kinds = T.folds(files.sparkSession), T.kinds(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = T.word_counter(folds, kinds)
        for batch in batches:
            path, texts = batch.column(0), batch.column(1)
            for at, end in pieces(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), WORDS_PIECE):
                place: dict[str, int] = {}
                number, which, tf, dl = [], [], [], []
                for k, text in enumerate(texts.slice(at, end - at).to_pylist(), at):
                    counts = count((text or b"").decode("utf-8", "replace"))
                    number += [place.setdefault(w, len(place)) for w in counts]
                    tf += counts.values()
                    which += [k] * len(counts)
                    dl += [counts.total()] * len(counts)
                number, which = np.array(number, np.int64), np.array(which, np.int64)
                order = np.argsort(number, kind="stable") if lists else slice(None)
                tokens, rows = pa.array(list(place), pa.string()), pa.array(which[order])
                values = [path.take(rows), pa.array(np.array(tf, np.int64)[order]), pa.array(np.array(dl, np.int64)[order])]
                if lists:
                    spots = pa.StructArray.from_arrays(values, ["path", "tf", "dl"])
                    first = np.searchsorted(number[order], np.arange(len(place) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([tokens, pa.ListArray.from_arrays(pa.array(first), spots)], ["token", "spots"])
                else:
                    yield pa.RecordBatch.from_arrays([tokens.take(pa.array(number)), *values], ["token", "path", "tf", "dl"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "token string, spots array<struct<path:string,tf:long,dl:long>>" if lists else "token string, path string, tf long, dl long")


def _word_rows(files: DataFrame, lists: bool) -> DataFrame:
    """As _words, with one row or spot for each word and path, also if rows repeat a path: only these are grouped, so nothing else is shuffled."""
    again = durable(files.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"))
    if again.isEmpty():
        return _words(files, lists)
    once = _words(files.join(again, "path", "left_anti"), lists)
    both = _words(files.join(again, "path", "left_semi"), False).groupBy("token", "path").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return once.unionByName(both.select("token", F.array(F.struct("path", "tf", "dl")).alias("spots")) if lists else both)


def word_lists(files: DataFrame) -> DataFrame:
    """(token, spots): words with (path, tf, dl) of some files, each pair of a word and a path once: a row for each word of about WORDS_PIECE characters."""
    return _word_rows(files, True)


def word_index(files: DataFrame) -> DataFrame:
    """(token, path, tf) over the words and camelCase parts of files (path, content)."""
    return _word_rows(files, False).drop("dl")


def doc_stats(files: DataFrame, postings: DataFrame) -> DataFrame:
    """(path, dl): how many words each file has, 0 if none."""
    dl = postings.groupBy("path").agg(F.sum("tf").alias("dl"))
    return files.select("path").join(dl, "path", "left").select("path", F.coalesce("dl", F.lit(0)).alias("dl"))


def changed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, chunk_no) of the chunks that only one side has or whose lines differ."""
    a, b = (c.select("path", "chunk_no", F.xxhash64("lines").alias(n)) for c, n in ((old, "old"), (new, "new")))
    return a.join(b, ["path", "chunk_no"], "full_outer").where("not (old <=> new)").select("path", "chunk_no")


def replaced(index: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """An index with the rows of what changed (path, or path and chunk_no) replaced by fresh ones.

    Hashes of what changed are sent to all tasks, if they are few enough, so that only rows with such a hash are shuffled.
    """
    changed = durable(changed)
    if changed.limit(MOST_CHANGED + 1).count() > MOST_CHANGED:
        return index.join(changed, changed.columns, "left_anti").unionByName(fresh)
    key = F.xxhash64(*changed.columns)
    keys = changed.select(key.alias("key")).distinct()
    rows = index.withColumn("key", key)
    kept = rows.join(F.broadcast(keys), "key", "left_anti").drop("key")
    # What only shares a hash with something that changed stays.
    doubtful = rows.join(F.broadcast(keys), "key", "left_semi").drop("key").join(changed, changed.columns, "left_anti")
    return kept.unionByName(doubtful).unionByName(fresh)


def wanted_trigrams(needles: DataFrame) -> DataFrame:
    """(query_id, clause, tri), each once, of needles (query_id, clause, literal)."""
    return needles.select("query_id", "clause", F.explode(T.query_trigrams(F.col("literal"))).alias("tri")).distinct()


def rarest(wanted: DataFrame, df: DataFrame) -> DataFrame:
    """The RAREST trigrams of each clause by frequencies (tri, df), ties to the smaller trigram."""
    ranked = wanted.join(df, "tri", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rare = Window.partitionBy("query_id", "clause").orderBy("df", "tri")
    return ranked.withColumn("r", F.row_number().over(rare)).where(F.col("r") <= RAREST)


def holding(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, clause, path, chunk_no) of the chunks that have all of a clause's trigrams in ranked."""
    need = F.count("*").over(Window.partitionBy("query_id", "clause")).alias("need")
    asked = sent(ranked.select("query_id", "clause", "tri", need))
    hits = index.join(asked, "tri").groupBy("query_id", "clause", "path", "chunk_no").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    return hits.where("n = need").select("query_id", "clause", "path", "chunk_no")


def candidates(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, clause, path, chunk_no) of the chunks that have all of a clause's trigrams joined here.

    needles: (query_id, clause, literal).
    """
    wanted = wanted_trigrams(needles)
    df = index.join(wanted.select("tri").distinct(), "tri", "left_semi").groupBy("tri").agg(F.count("*").alias("df"))
    return holding(rarest(wanted, df), index)


def verified(found: DataFrame, chunks: DataFrame, queries: DataFrame, match: Column, small: bool = False) -> DataFrame:
    """(query_id, path, line_no, text) of lines that match in candidate chunks (query_id, path, chunk_no), each once. match uses columns text and pattern.

    small: the candidates are few enough to be sent to all tasks.
    """
    asked = found.join(sent(queries.select("query_id", F.col("text").alias("pattern"))), "query_id")
    # Patterns go to the chunks, which are shuffled by path only.
    rows = chunks.join(asked.hint("broadcast") if small else asked, ["path", "chunk_no"])
    return lines_in(rows, "query_id", "pattern").where(match).select("query_id", "path", "line_no", "text")


def literal_match() -> Column:
    return F.contains(F.col("text"), F.col("pattern"))


def regex_match() -> Column:
    return F.expr("text rlike pattern")


def spots(found: DataFrame) -> DataFrame:
    return found.select("query_id", "path", "chunk_no").distinct()


def literal_needles(queries: DataFrame) -> DataFrame:
    """(query_id, clause, literal) of the queries that have a trigram."""
    return queries.where(F.length("text") >= 3).select("query_id", F.lit(0).alias("clause"), F.col("text").alias("literal"))


def search_literal(queries: DataFrame, chunks: DataFrame, index: DataFrame, within: Column | None = None) -> DataFrame:
    """Hits of literals of at least three characters; within: a condition on path."""
    if within is not None:
        chunks, index = chunks.where(within), index.where(within)
    return verified(spots(candidates(literal_needles(queries), index)), chunks, queries, literal_match())


def search_scan(queries: DataFrame, lines: DataFrame, match: Column) -> DataFrame:
    """Hits by reading all lines, for queries that no trigram helps, in blocks of about BLOCK queries."""
    asked = queries.select("query_id", F.col("text").alias("pattern"))
    blocks = max(1, -(-asked.count() // BLOCK))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [lines.join(F.broadcast(asked.where(part == k)), match).select("query_id", "path", "line_no", "text") for k in range(blocks)]
    return functools.reduce(DataFrame.unionByName, found)


def regex_needles(queries: list[tuple[int, str]]) -> tuple[list[tuple[int, int, str]], list[int]]:
    """(query_id, clause, literal) rows of patterns with required literals; the ids of those without."""
    rows, scans = [], []
    for i, pattern in queries:
        clauses = literals.required(pattern)
        if clauses is None:
            scans.append(i)
        for c, words in enumerate(clauses or []):
            rows += [(i, c, w) for w in sorted(words)]
    return rows, scans


def search_regex(queries: DataFrame, patterns: list[tuple[int, str]], chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Hits of regular expressions: by required literals where there are any, by a scan otherwise."""
    rows, scans = regex_needles(patterns)
    needles = chunks.sparkSession.createDataFrame(rows, "query_id long, clause int, literal string")
    indexed = verified(spots(candidates(needles, index)), chunks, queries, regex_match())
    return indexed.unionByName(search_scan(queries.where(F.col("query_id").isin(scans)), lines_in(chunks), regex_match()))


def top_hits(hits: DataFrame, k: int = HITS) -> DataFrame:
    """The first k hits of each query in (path, line) order; more: whether others follow."""
    w = Window.partitionBy("query_id").orderBy("path", "line_no")
    first = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    more = first.groupBy("query_id").agg((F.max("rank") > k).alias("more"))
    return first.where(F.col("rank") <= k).join(more, "query_id")


def summary(hits: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """Per query: hits and files, with + behind the count when it exceeds the limit."""
    n = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))
    label = F.when(F.col("n") > most, F.lit(f"{most}+")).otherwise(F.col("n").cast("string"))
    return n.select("query_id", F.col("n").alias("hits"), "files", label.alias("label"))


def context(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """The n lines around each hit, each once, without the hits: an equi-join on exploded line numbers."""
    around = hits.select("query_id", "path", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no")).distinct()
    others = around.join(hits.select("query_id", "path", "line_no"), ["query_id", "path", "line_no"], "left_anti")
    return others.join(lines, ["path", "line_no"]).select("query_id", "path", "line_no", "text")


def groups(hits: DataFrame, around: DataFrame) -> DataFrame:
    """Hits and context as runs of adjacent lines: first and last line and the number of hits of each."""
    rows = hits.select("query_id", "path", "line_no", F.lit(1).alias("hit")).unionByName(around.select("query_id", "path", "line_no", F.lit(0).alias("hit")))
    w = Window.partitionBy("query_id", "path").orderBy("line_no")
    gap = (F.col("line_no") - F.lag("line_no").over(w) > 1).cast("int")
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("group_no", F.sum("gap").over(w))
    return rows.groupBy("query_id", "path", "group_no").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum("hit").alias("hits"))


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, term_no, kind, token): a term's whole word, and its parts if it has several."""
    terms = queries.select("query_id", F.posexplode(T.query_terms(F.col("text"))).alias("term_no", "t"))
    whole = terms.select("query_id", "term_no", F.lit("whole").alias("kind"), F.col("t.whole").alias("token"))
    parts = terms.where(F.size("t.parts") > 1).select("query_id", "term_no", F.lit("part").alias("kind"), F.explode("t.parts").alias("token"))
    return whole.unionByName(parts).distinct()


def bm25(queries: DataFrame, postings: DataFrame, stats: DataFrame, within: Column | None = None) -> DataFrame:
    """(query_id, path, score): files with a term whole or with all its parts, by Okapi BM25 over all the query's words.

    within: a condition on path for the files listed; frequencies and lengths are those of all files.
    """
    words = phrases(queries)
    df = postings.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    totals = stats.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return scored(words, postings.join(words.select("token").distinct(), "token", "left_semi").join(stats, "path"), df, totals, within)


def scored(words: DataFrame, postings: DataFrame, df: DataFrame, totals: DataFrame, within: Column | None = None) -> DataFrame:
    """bm25 of phrases' words over postings (token, path, tf, dl), frequencies (token, df) and totals (n_docs, avgdl), one row."""
    need = words.where("kind = 'part'").groupBy("query_id", "term_no").agg(F.countDistinct("token").alias("need"))
    uses = words.join(need, ["query_id", "term_no"], "left").groupBy("query_id", "token").agg(F.collect_list(F.struct("term_no", (F.col("kind") == "whole").alias("whole"), "need")).alias("uses"))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    asked = sent(uses.join(df, "token").crossJoin(totals).select("query_id", "token", "uses", idf.alias("idf"), "avgdl"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = (postings if within is None else postings.where(within)).join(asked, "token")
    # A file has few of a query's words; all of them meet in one row.
    files = hits.groupBy("query_id", "path").agg(F.sum(weight).alias("score"), F.flatten(F.collect_list("uses")).alias("uses"))
    parts = lambda t: F.size(F.filter("uses", lambda u: ~u["whole"] & (u["term_no"] == t["term_no"])))
    listed = F.exists("uses", lambda t: t["whole"] | (parts(t) == t["need"]))
    return files.where(listed).select("query_id", "path", F.round("score", 6).alias("score"))


def top_words(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "path")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_lines(ranked: DataFrame, lines: DataFrame, queries: DataFrame, n: int = BEST) -> DataFrame:
    """Each ranked file's n best lines by line score, ties to the earlier line."""
    terms = queries.select("query_id", T.query_terms(F.col("text")).alias("terms"))
    asked = sent(durable(ranked.select("query_id", "path", "rank")).join(sent(terms), "query_id"))
    rows = worded_lines(lines.join(sent(asked.select("path").distinct()), "path", "left_semi")).join(asked, "path")
    rows = rows.withColumn("line_score", T.words_score(F.col("plain"), F.col("words"), F.col("terms"))).where("line_score > 0")
    w = Window.partitionBy("query_id", "path").orderBy(F.desc("line_score"), "line_no")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("query_id", "path", "rank", "line_no", "line_score")


def ranked_budget(ranked: DataFrame, lines_found: DataFrame, budget: int) -> DataFrame:
    """How many lines each ranked file may show, spending the budget in rank order; more: a ranked file is left."""
    n = lines_found.groupBy("query_id", "path").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.join(n, ["query_id", "path"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("spent", F.coalesce(F.sum("n").over(w), F.lit(0)))
    more = rows.groupBy("query_id").agg(F.max(F.col("spent") >= budget).alias("more"))
    shown = rows.where((F.col("n") > 0) & (F.col("spent") < budget))
    return shown.join(more, "query_id").select("query_id", "path", "rank", F.least("n", F.lit(budget) - F.col("spent")).alias("shown"), "more")
