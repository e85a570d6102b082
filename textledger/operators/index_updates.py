"""A stored trigram index that follows edits of its files.

A chunk keeps its number for good, and its first line may move. An update compares the files' hashes with
the recorded ones, finds the window of lines that changed in each changed file, and indexes anew only the
chunks that overlap this window; the later chunks of the file get new first lines, their text and postings
stay. An update is a partition of each of the tables beside the base: chunks and postings (new ones), gone
(path, chunk_no), moves (path, chunk_no, moved), frequencies (tri, df) and files (path, hash; null for
removed files). It counts once its row is in the table of commits, which is written last, so an update that
died is as if it had never been; the next one finds the same changes again. One writer at a time.

A search reads the same few buckets of the base and of each update, and drops the chunks that are gone
from the candidates. Frequencies of chunks that are gone still count, which only affects which trigrams
are looked up. compact() merges all into a new base without cutting a text into trigrams again.

Defined results: files whose lines are the same but not their bytes change no chunk. A file without lines
has no chunks. Null contents are empty. Files are unique by path. An update without changes commits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import durable
from . import search as S
from .stored_search import PER_BUCKET, SCHEMAS, Buckets, bucket_of, write_buckets, write_frequencies, write_layout

#: Chunks whose spots compact() may pack in a row; a key may be in all of them.
PACKED = 1_000

UPDATE_SCHEMAS = {
    "chunks": "path string, chunk_no int, first int, lines array<string>, bucket int",
    "postings": SCHEMAS["tri postings"],
    "frequencies": SCHEMAS["tri frequencies"],
    "gone": "path string, chunk_no int",
    "moves": "path string, chunk_no int, moved int, n int",
    "files": "path string, hash string, n int",
}


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))


def equal_lines(a: Column, b: Column) -> Column:
    """How many lines a and b have in common from the first on."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def replaced_chunks(changed: DataFrame) -> DataFrame:
    """What an update does to changed files (path, old, new, next), a row each.

    old: the chunks (start, chunk_no, lines) in order, new: the lines, next: the first free number. Gives path,
    gone (numbers), moves (chunk_no, moved) and fresh (chunk_no, first, lines). The window is what is left between
    the common first and last lines. Its chunks are cut anew into even parts of about CHUNK lines, at most
    half as many again; lines behind the last chunk are added to it if it isn't full.
    """
    lines = F.flatten(F.transform("old", lambda c: c["lines"]))
    rows = changed.withColumns({"was": lines, "n_old": F.size(lines), "n_new": F.size("new")})
    rows = rows.withColumn("lo", equal_lines(F.col("was"), F.col("new")))
    tail = equal_lines(F.reverse("was"), F.reverse("new"))
    rows = rows.withColumn("hi", F.col("n_old") - F.least(tail, F.least("n_old", "n_new") - F.col("lo")))
    same = (F.col("lo") == F.col("n_old")) & (F.col("n_old") == F.col("n_new"))
    end = lambda c: c["start"] + F.size(c["lines"])
    none = F.slice("old", F.lit(1), F.lit(0))
    inside = F.filter("old", lambda c: (end(c) > F.col("lo")) & (c["start"] < F.greatest("hi", F.col("lo") + 1)))
    short = F.filter("old", lambda c: (end(c) == F.col("n_old")) & (F.size(c["lines"]) < S.CHUNK))
    rows = rows.withColumn("hit", F.when(same, none).when(F.col("lo") == F.col("n_old"), short).otherwise(inside))
    last = F.get("hit", F.size("hit") - 1)
    rows = rows.withColumns({"begin": F.coalesce(F.get("hit", F.lit(0))["start"], "lo"), "until": F.coalesce(last["start"] + F.size(last["lines"]), "lo"), "delta": F.col("n_new") - F.col("n_old")})
    rows = rows.withColumn("n", F.col("until") + F.col("delta") - F.col("begin"))
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.round(F.col("n") / S.CHUNK).cast("int")))
    at = lambda k: F.floor(k.cast("long") * F.col("n") / F.col("parts")).cast("int")
    part = lambda k: F.struct(
        (F.col("next") + k).alias("chunk_no"), (F.col("begin") + at(k)).alias("first"), F.slice("new", F.col("begin") + at(k) + 1, at(k + 1) - at(k)).alias("lines")
    )
    later = F.filter("old", lambda c: (c["start"] >= F.col("until")) & (F.col("delta") != 0))
    return rows.select(
        "path", F.transform("hit", lambda c: c["chunk_no"]).alias("gone"),
        F.transform(later, lambda c: F.struct(c["chunk_no"].alias("chunk_no"), (c["start"] + F.col("delta")).alias("moved"))).alias("moves"),
        F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), part)).alias("fresh"),
    )


class FollowedIndex(Buckets):
    """A stored trigram index and the updates since, in the folder updates. It searches as Buckets do."""

    def __init__(self, base: Buckets, updates: str):
        super().__init__(base.spark, base.at, base.key)
        self.updates = updates

    @classmethod
    def start(cls, base: Buckets, files: DataFrame, updates: str) -> FollowedIndex:
        """An index without updates; files (path, content) are those that the base was made of."""
        index = cls(base, updates)
        index.commit(0, lambda at: hashed(files).withColumn("n", F.lit(0)).write.parquet(at("files")))
        return index

    def commits(self) -> list[tuple[int, str]]:
        """(n, partition) of the updates in order; 0 holds the base's files only. A row for each update until compact()."""
        rows = self.spark.read.schema("n int, part string").parquet(f"{self.updates}/commits")
        return [(r.n, r.part) for r in rows.orderBy("n").collect()]

    def commit(self, n: int, write: Callable[[Callable[[str], str]], None]) -> None:
        """Update n: write gets the place for each table's name, and the update counts when it is done."""
        part = f"{n}-{uuid.uuid4().hex}"
        write(lambda name: f"{self.updates}/{name}/part={part}")
        self.spark.createDataFrame([(n, part)], "n int, part string").coalesce(1).write.mode("append").parquet(f"{self.updates}/commits")
        self.tables.clear()

    def added(self, name: str) -> DataFrame:
        """A table's rows in all updates that count."""
        if f"added {name}" not in self.tables:
            parts = [part for n, part in self.commits() if n or name == "files"]
            if parts:
                rows = self.spark.read.schema(UPDATE_SCHEMAS[name] + ", part string").parquet(f"{self.updates}/{name}")
                rows = rows.where(F.col("part").isin(parts)).drop("part")
            else:
                rows = self.spark.createDataFrame([], UPDATE_SCHEMAS[name])
            self.tables[f"added {name}"] = rows
        return self.tables[f"added {name}"]

    def table(self, name: str) -> DataFrame:
        if name not in ("chunks", "postings", "frequencies"):
            return super().table(name)
        if name not in self.tables:
            base = self.spark.read.schema(UPDATE_SCHEMAS[name]).parquet(f"{self.at}/{name}")
            both = base.unionByName(self.added(name))
            self.tables[name] = both.groupBy(self.key).agg(F.sum("df").alias("df")) if name == "frequencies" else both
        return self.tables[name]

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (path, chunk_no, ...) of chunks that aren't gone, with moved: their first line's place since, or null."""
        moved = self.added("moves").groupBy("path", "chunk_no").agg(F.max_by("moved", "n").alias("moved"))
        return rows.join(self.added("gone"), ["path", "chunk_no"], "left_anti").join(moved, ["path", "chunk_no"], "left")

    def placed(self, parts: list[int] | None = None) -> DataFrame:
        """(path, chunk_no, first, lines) of all chunks that aren't gone, in some buckets of paths or all."""
        return self.live(self.chunks(parts)).withColumn("first", S.first_line("moved", "first")).drop("moved")

    def update(self, files: DataFrame) -> bool:
        """Brings the index from its recorded files to files (path, content). False if nothing changed."""
        files = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
        known = self.added("files").groupBy("path").agg(F.max_by("hash", "n").alias("old"))
        both = known.where("old IS NOT NULL").join(hashed(files), "path", "full_outer").where("not (old <=> hash)")
        changed = durable(both.select("path", "hash"))
        # One row with at most MOST_BUCKETS numbers.
        parts = changed.agg(F.collect_set(bucket_of("path", self.buckets)).alias("parts")).first().parts
        if not parts:
            return False
        names = changed.select("path")
        order = F.struct(F.col("first").alias("start"), "chunk_no", "lines")
        old = self.placed(parts).join(names, "path", "left_semi").groupBy("path").agg(F.sort_array(F.collect_list(order)).alias("old"))
        used = self.chunks(parts).join(names, "path", "left_semi").groupBy("path").agg((F.max("chunk_no") + 1).alias("next"))
        new = files.join(names, "path", "left_semi").select("path", T.split_lines(F.col("content")).alias("new"))
        empty = F.array().cast("array<string>")
        rows = names.join(old, "path", "left").join(used, "path", "left").join(new, "path", "left").select(
            "path", F.coalesce("old", F.array().cast("array<struct<start:int,chunk_no:int,lines:array<string>>>")).alias("old"),
            F.coalesce("next", F.lit(0)).alias("next"), F.coalesce("new", empty).alias("new"),
        )
        plan = durable(replaced_chunks(rows))
        n = self.commits()[-1][0] + 1

        def write(at: Callable[[str], str]) -> None:
            fresh = plan.select("path", F.explode("fresh").alias("c")).select("path", "c.*")
            write_buckets(fresh, at("chunks"), "path", self.buckets, "chunk_no")
            postings = S.trigram_lists(fresh)
            write_buckets(postings, at("postings"), "tri", self.buckets)
            write_frequencies(self.spark.read.schema(UPDATE_SCHEMAS["postings"]).parquet(at("postings")), at("frequencies"), "tri")
            plan.select("path", F.explode("gone").alias("chunk_no")).write.parquet(at("gone"))
            moves = plan.select("path", F.explode("moves").alias("m")).select("path", "m.*", F.lit(n).alias("n"))
            moves.write.parquet(at("moves"))
            changed.withColumn("n", F.lit(n)).write.parquet(at("files"))

        self.commit(n, write)
        return True

    def compact(self, at: str, updates: str) -> FollowedIndex:
        """The same index as a new base without updates: chunks and postings that are gone are left out, none is cut anew."""
        index = FollowedIndex(Buckets(self.spark, at, self.key), updates)
        write_buckets(self.placed().drop("bucket"), f"{at}/chunks", "path", self.buckets, "chunk_no")
        kept = self.postings().join(self.added("gone"), ["path", "chunk_no"], "left_anti")
        # Again lists of what is packed together, at most some hundred spots.
        part = F.pmod(F.xxhash64("path", "chunk_no"), F.lit(1 + self.buckets * PER_BUCKET // PACKED))
        kept = kept.groupBy(self.key, part.alias("part")).agg(F.collect_list(F.struct("path", "chunk_no")).alias("spots")).drop("part")
        write_buckets(kept, f"{at}/postings", self.key, self.buckets)
        written = self.spark.read.schema(UPDATE_SCHEMAS["postings"]).parquet(f"{at}/postings")
        write_frequencies(written, f"{at}/frequencies", self.key)
        write_layout(self.spark, at, self.buckets)
        known = self.added("files").groupBy("path").agg(F.max_by("hash", "n").alias("hash")).where("hash IS NOT NULL")
        index.commit(0, lambda to: known.withColumn("n", F.lit(0)).write.parquet(to("files")))
        return index
