"""Search indexes that are stored in buckets, so that a search opens only the buckets it needs.

A trigram index is a folder of three tables: chunks (path, chunk_no, lines), by a hash of the path;
postings (tri, spots), by a hash of the trigram; frequencies (tri, df). A word index has
postings (token, spots), by a hash of the word; frequencies (token, df); totals, one row. Spots are lists
of (path, chunk_no) or (path, tf, dl), as the texts that were read together have them: several rows for a key. Each
bucket is a folder, and rows are sorted in it, so equal keys are packed as runs and row groups have
narrow ranges. The number of buckets grows with the chunks or files, to at most MOST_BUCKETS, and so does
the number of files over which a bucket is spread.

A search looks up how many postings its trigrams have, takes each clause's rarest, and reads only their
buckets; then only the buckets of the chunks found. Both choices are literal filters in the plan. A batch
of queries with more than MOST_KEYS different keys reads all buckets by a plain join, to the same result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import durable
from . import search as S

SCHEMAS = {
    "chunks": "path string, chunk_no int, lines array<string>, bucket int",
    "tri postings": "tri string, spots array<struct<path:string,chunk_no:int>>, bucket int",
    "tri frequencies": "tri string, df long",
    "token postings": "token string, spots array<struct<path:string,tf:long,dl:long>>, bucket int",
    "token frequencies": "token string, df long",
    "totals": "n_docs long, avgdl double",
    "layout": "buckets int",
}
#: Chunks, or files of a word index, for each bucket; about four million postings.
PER_BUCKET = 2_000
#: Rows of one key for each task that writes them.
SHARE = 4_000_000
LEAST_BUCKETS, MOST_BUCKETS = 64, 65_536
#: Most keys that a plan names one by one.
MOST_KEYS = 4_096
#: Most characters of paths, and most rows, that are sent to all tasks at once.
MOST_SENT, MOST_ROWS = 10_000_000, 100_000


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_for(rows: DataFrame) -> int:
    return min(max(rows.count() // PER_BUCKET, LEAST_BUCKETS), MOST_BUCKETS)


def write_buckets(rows: DataFrame, at: str, key: str, buckets: int, *order: str) -> None:
    """rows in one folder for each bucket of key, sorted by key and then by order.

    A key may be in every chunk or file; its rows are dealt over as many tasks as hold SHARE of those each.
    """
    spread = -(-buckets * PER_BUCKET // SHARE)
    rows = rows.withColumn("bucket", bucket_of(key, buckets))
    path = F.col("path") if "path" in rows.columns else F.col("spots")[0]["path"]
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64(path, F.lit(1)), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", key, *order).write.partitionBy("bucket").parquet(at)


def write_frequencies(postings: DataFrame, at: str, key: str) -> None:
    """How many spots each key of postings (key, spots) has."""
    df = postings.groupBy(key).agg(F.sum(F.size("spots")).alias("df"))
    df.sortWithinPartitions(key).write.parquet(at)


class Buckets:
    """A stored index; the number of its buckets is a table of one row beside the others. Each table is listed once."""

    def __init__(self, spark: SparkSession, at: str, key: str):
        self.spark, self.at, self.key = spark, at, key
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            schema = SCHEMAS.get(name) or SCHEMAS[f"{self.key} {name}"]
            self.tables[name] = self.spark.read.schema(schema).parquet(f"{self.at}/{name}")
        return self.tables[name]

    @functools.cached_property
    def buckets(self) -> int:
        return self.table("layout").first().buckets

    def named(self, keys: DataFrame) -> list[str] | None:
        """The different keys of a table of one column, or None if there are more than MOST_KEYS."""
        found = [r[0] for r in keys.distinct().limit(MOST_KEYS + 1).collect()]
        return found if len(found) <= MOST_KEYS else None

    def frequencies(self, keys: list[str] | None = None) -> DataFrame:
        rows = self.table("frequencies")
        return rows if keys is None else rows.where(F.col(self.key).isin(keys))

    def postings(self, keys: list[str] | None = None) -> DataFrame:
        """The postings of keys, from their buckets only; all of them for None."""
        rows = self.table("postings")
        if keys is not None:
            hashed = self.spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, keys)).cast("array<string>"), lambda k: bucket_of(k, self.buckets))))
            rows = rows.where(F.col("bucket").isin(hashed.first()[0]) & F.col(self.key).isin(keys))
        return rows.select(self.key, F.inline("spots"))

    def chunks(self, parts: list[int] | None = None) -> DataFrame:
        """The chunks in some buckets of paths; all of them for None."""
        rows = self.table("chunks")
        return (rows if parts is None else rows.where(F.col("bucket").isin(parts))).drop("bucket")

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (path, chunk_no, ...) whose chunks are still there: here all."""
        return rows


def write_layout(spark: SparkSession, at: str, buckets: int) -> None:
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{at}/layout")


def write_trigrams(chunks: DataFrame, at: str) -> Buckets:
    """A stored trigram index of chunks (path, chunk_no, lines)."""
    spark = chunks.sparkSession
    index, buckets = Buckets(spark, at, "tri"), buckets_for(chunks)
    write_buckets(chunks, f"{at}/chunks", "path", buckets, "chunk_no")
    write_buckets(S.trigram_lists(index.chunks()), f"{at}/postings", "tri", buckets)
    write_frequencies(index.table("postings"), f"{at}/frequencies", "tri")
    write_layout(spark, at, buckets)
    return index


def write_words(files: DataFrame, at: str) -> Buckets:
    """A stored word index of files (path, content); dl is the number of a file's words."""
    spark = files.sparkSession
    index, buckets = Buckets(spark, at, "token"), buckets_for(files)
    write_buckets(S.word_lists(files), f"{at}/postings", "token", buckets)
    write_frequencies(index.table("postings"), f"{at}/frequencies", "token")
    n_docs = files.agg(F.count("*").alias("n_docs"))  # one row, as is the other
    tf = F.aggregate("spots", F.lit(0).cast("long"), lambda n, p: n + p["tf"])
    n_words = index.table("postings").agg(F.coalesce(F.sum(tf), F.lit(0)).alias("n_words"))
    totals = n_docs.crossJoin(n_words).select("n_docs", F.try_divide("n_words", "n_docs").alias("avgdl"))
    totals.coalesce(1).write.parquet(f"{at}/totals")
    write_layout(spark, at, buckets)
    return index


def candidates(needles: DataFrame, index: Buckets, within: Column | None = None) -> DataFrame:
    """(query_id, clause, path, chunk_no) as of search.candidates, from the buckets of the rarest trigrams."""
    wanted = S.wanted_trigrams(needles)
    keys = index.named(wanted.select("tri"))
    ranked = S.rarest(wanted, index.frequencies(keys))
    chosen = None if keys is None else index.named(ranked.select("tri"))
    postings = index.postings(chosen)
    return S.holding(ranked, postings if within is None else postings.where(within))


def verified(found: DataFrame, index: Buckets, queries: DataFrame, match: Column) -> DataFrame:
    """(query_id, path, line_no, text) of the lines that match, from the buckets that hold candidates."""
    found = durable(index.live(found.select("query_id", "path", "chunk_no").distinct()))
    # One row with at most MOST_BUCKETS numbers.
    size = found.agg(F.count("*").alias("n"), F.sum(F.length("path")).alias("chars"), F.collect_set(bucket_of("path", index.buckets)).alias("parts")).first()
    small = size.n <= MOST_ROWS and (size.chars or 0) <= MOST_SENT
    return S.verified(found, index.chunks(size.parts), queries, match, small)


def search_literal(queries: DataFrame, index: Buckets, within: Column | None = None) -> DataFrame:
    """Hits of literals of at least three characters; within: a condition on path."""
    return verified(candidates(S.literal_needles(queries), index, within), index, queries, S.literal_match())


def search_regex(queries: DataFrame, patterns: list[tuple[int, str]], index: Buckets) -> DataFrame:
    """Hits of regular expressions: by required literals where there are any, by a scan otherwise."""
    rows, scans = S.regex_needles(patterns)
    needles = index.spark.createDataFrame(rows, "query_id long, clause int, literal string")
    hits = verified(candidates(needles, index), index, queries, S.regex_match())
    if not scans:
        return hits
    return hits.unionByName(S.search_scan(queries.where(F.col("query_id").isin(scans)), S.lines_in(index.live(index.chunks())), S.regex_match()))


def bm25(queries: DataFrame, index: Buckets, within: Column | None = None) -> DataFrame:
    """(query_id, path, score) as of search.bm25, from the buckets of the queries' words."""
    words = S.phrases(queries)
    keys = index.named(words.select("token"))
    return S.scored(words, index.postings(keys), index.frequencies(keys), index.table("totals"), within)
