"""Periodic runs of words in whole texts, by internal pattern matching, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q that is at least max(least, 2 * q) words
long and that no neighbouring word extends keeping that period. Texts are put together to shards of about
`SHARD` bytes (a longer text is a shard of its own); words of different texts get different numbers, so
nothing matches over a text's end. Prefix doubling sorts the shard's suffixes and on the way names all
dyadic blocks: those of m = 1, 2, 4, ... words that start at multiples of m. A run of length L contains,
for the m with 2 * m - 1 <= L - q < 4 * m - 1, such a block that occurs again q words on. So each block
that occurs more than once asks for its occurrences in the window of the next 4 * m - 2 words: its range of
the suffix array is a range of a wavelet matrix over that array, in which counting below the window's
borders and then taking the k-th smallest values are range successor queries. Occurrences that follow
each other by p <= m words from the block on are a progression, and only p is a candidate period, since
its multiples can't be smallest. Blocks with the same distance are merged to stretches, which are extended
word by word to both sides; of runs with the same borders the smallest period stays.

Every text is one row of one task, nothing is shuffled. A shard needs about 150 bytes for each of its words.

Defined results: null and empty texts have no words and no runs, and an empty collapsed text; ids may be
null or repeat, every row gives a row; an empty table gives none; other columns are ignored. Two runs of
different period may overlap; both are listed. plant() leaves rows without an id as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

SHARD = 1 << 19
LEAST = 12
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Wavelet:
    """A wavelet matrix over non-negative numbers: counts and order statistics of many ranges at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        level = values.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(len(level) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(level) - int(ones[-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in each range are less than its bound."""
        out, whole = np.zeros(len(lo), np.int64), hi - lo
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            lo1, hi1 = self.ones[k][lo], self.ones[k][hi]
            one = (bound >> b) & 1 == 1
            out += np.where(one, (hi - hi1) - (lo - lo1), 0)
            lo = np.where(one, self.zeros[k] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[k] + hi1, hi - hi1)
        return np.where(bound >> self.bits > 0, whole, out)

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value of each range, from 0."""
        out = np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            lo1, hi1 = self.ones[level][lo], self.ones[level][hi]
            zeros = (hi - hi1) - (lo - lo1)
            one = k >= zeros
            out += one.astype(np.int64) << b
            k = np.where(one, k - zeros, k)
            lo = np.where(one, self.zeros[level] + lo1, lo - lo1)
            hi = np.where(one, self.zeros[level] + hi1, hi - hi1)
        return out


def sorted_blocks(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array, and for each m the blocks that occur more than once with their ranges in it."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    fresh = np.concatenate(([True], np.diff(words[order]) != 0))
    slots = np.arange(n)
    rank, size = np.empty(n, np.int64), np.empty(n, np.int64)
    blocks, m = [], 1
    while True:
        starts = np.flatnonzero(fresh)
        counts = np.diff(np.append(starts, len(slots)))
        rank[order[slots]] = np.repeat(slots[starts], counts)
        size[order[slots]] = np.repeat(counts, counts)
        at = np.arange(0, n - m + 1, m)
        at = at[size[at] > 1]
        if len(at):
            blocks.append((m, at, rank[at], rank[at] + size[at]))
        slots = slots[np.repeat(counts > 1, counts)]
        if not len(slots):
            return order, blocks
        held = order[slots]
        after = np.where(held + m < n, rank[np.minimum(held + m, n - 1)] + 1, 0)
        key = rank[held] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[slots] = held[by]
        fresh = np.concatenate(([True], np.diff(key[by]) != 0))
        m *= 2


def candidates(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, distance) of stretches whose words stand again that distance on."""
    order, blocks = sorted_blocks(words) if len(words) else (words, [])
    found = []
    index = Wavelet(order) if blocks else None
    for m, at, lo, hi in blocks:
        first = index.below(lo, hi, at + 1)
        last = index.below(lo, hi, at + 4 * m - 1)
        many = last - first
        which = np.repeat(np.arange(len(at)), many)
        if not len(which):
            continue
        nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        away = index.smallest(lo[which], hi[which], first[which] + nth) - at[which]
        # the first occurrence and each later one that isn't the next member of a progression from the block on
        step = np.repeat(away[nth == 0], many[many > 0])
        regular = (away == step * (nth + 1)) & (step <= m)
        broken = np.where(regular, 0, 1)
        total = np.cumsum(broken)
        before = np.repeat((total - broken)[nth == 0], many[many > 0])
        keep = (nth == 0) | (total > before)
        found.append(np.stack((away[keep], at[which[keep]], np.full(int(keep.sum()), m))))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    away, start, m = np.concatenate(found, axis=1)
    by = np.lexsort((start, away))
    away, start, end = away[by], start[by], (start + m)[by]
    # a running maximum within each distance: ends are below the shard's length
    reach = np.maximum.accumulate(away * (len(words) + 1) + end) - away * (len(words) + 1)
    new = np.concatenate(([True], (away[1:] != away[:-1]) | (start[1:] > reach[:-1])))
    heads = np.flatnonzero(new)
    return start[heads], reach[np.append(heads[1:], len(start)) - 1], away[heads]


def extended(words: np.ndarray, at: np.ndarray, away: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on, going by step (1 or -1), equal those `away` words later."""
    n = len(words)
    padded = np.concatenate(([-1], words, [-2]))  # equal to no word
    out = np.zeros(len(at), np.int64)
    live, chunk = np.arange(len(at)), 4
    while len(live):
        still = []
        for part in np.array_split(live, len(live) * chunk // (1 << 22) + 1):
            to = (at[part] + step * out[part])[:, None] + step * np.arange(chunk)
            same = padded[np.clip(to, -1, n) + 1] == padded[np.clip(to + away[part][:, None], -1, n) + 1]
            whole = same.all(axis=1)
            out[part] += np.where(whole, chunk, np.argmin(same, axis=1))
            still.append(part[whole])
        live, chunk = np.concatenate(still), min(chunk * 4, 1 << 16)
    return out


def find_runs(words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period. Words of different texts are different."""
    start, end, away = candidates(words)
    end = end + extended(words, end, away, 1) + away
    start = start - extended(words, start - 1, away, -1)
    keep = end - start >= np.maximum(least, 2 * away)
    rows = np.unique(np.stack((start[keep], end[keep], away[keep]), axis=1), axis=0)  # sorted
    first = np.concatenate(([True], (np.diff(rows[:, :2], axis=0) != 0).any(axis=1))) if len(rows) else np.zeros(0, bool)
    start, end, away = rows[first].T
    by = np.lexsort((away, start))
    return start[by], (end - start)[by], away[by]


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """All texts' words as numbers, different in different texts."""
    known: dict[bytes, int] = {}
    words = np.array([known.setdefault(w, len(known)) for t in texts for w in t], np.int64)
    return np.repeat(np.arange(len(texts)), [len(t) for t in texts]) * len(known) + words


def collapse(texts: list[list[bytes]], least: int = LEAST) -> tuple[list[int], np.ndarray, list[bytes]]:
    """For a shard's texts: where each text's runs begin in the rows of (start, length, period), those rows, the collapsed texts."""
    lengths = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(lengths) - lengths
    start, length, period = find_runs(numbered(texts), least)
    owner = np.searchsorted(first, start, side="right") - 1
    cover = np.zeros(int(lengths.sum()) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, start + length, -1)
    kept = np.cumsum(cover)[:-1] == 0
    hit = set(owner.tolist())
    out = []
    for k, t in enumerate(texts):
        if k in hit:
            t = [w for w, stays in zip(t, kept[first[k] : first[k] + lengths[k]].tolist(), strict=True) if stays]
        out.append(b" ".join(t))
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    return offsets.tolist(), np.stack((start - first[owner], length, period)), out


def shards(texts: pa.Array, most: int = SHARD) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes."""
    start, held = 0, 0
    for i in range(len(texts)):
        size = texts[i].as_buffer().size if texts[i].is_valid else 0
        if held and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row: its runs by start, then period, and its words without the repeats, joined by spaces."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, end in shards(b.column(1)):
                # bytes.split() cuts at the same six characters as the words' pattern
                texts = [t.encode().split() if t else [] for t in b.column(1)[start:end].to_pylist()]
                offsets, found, collapsed = collapse(texts, least)
                runs = pa.StructArray.from_arrays([pa.array(x) for x in found], fields=list(ARROW_RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[start:end],
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("id", id_col)


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id, text) in which every tenth text, by checksum of its id, repeats a piece of itself from some word on.

    With n words, h the checksum and g = floor(h / 10): word i >= a becomes word a + (i - a) % p of the
    old text, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_old"), F.crc32(F.col(id_col).cast("string").cast("binary")).alias("_h"))
    chosen = F.coalesce(F.col("_h") % 10 == 0, F.lit(False))
    # an outer case, so that only the chosen texts are taken apart
    rows = rows.select(id_col, "_old", F.floor(F.col("_h") / 10).alias("_g"), F.when(chosen, F.regexp_extract_all("_old", F.lit(WORD), F.lit(0))).alias("_words"))
    n = F.size("_words").cast("long")
    rows = rows.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    rows = rows.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))

    def word(i: Column) -> Column:
        j = F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
        return F.get("_words", j.cast("int"))

    new = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size("_words").cast("long") - 1), word), " ")
    return rows.select(id_col, F.when(F.col("_a").isNotNull(), new).otherwise(F.col("_old")).alias(text_col))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(plant(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
