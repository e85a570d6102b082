"""Benchmark decontamination with an FM-index over each shard of the training documents.

A shard is an Arrow batch of documents. Its words are numbered by the benchmark's vocabulary; runs
of such words, cut wherever another word stands, are the text that is indexed, since no window can
reach over a word that the benchmark lacks, nor sit in a run shorter than the shortest window. The
index is a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet matrix with
rank counts, and suffix positions sampled at every 8th word. All windows of the benchmark are
searched backward at once; occurrences are located by walking to a sampled position; overlapping
occurrences merge to removal spans. No document leaves its task, so nothing is shuffled.

The benchmark is broadcast in blocks of about `block_bytes` of text (its size is summed first), one at a
time: a larger benchmark makes a pass over the documents for each block, whose spans are merged with
those before in a written table, and the block is dropped from driver and tasks before the next is read.

Defined results: null and empty texts have no words and no hits; a document or item id may be null
or repeat, every document row gives a row; items without an id still mark words but aren't listed,
an id that repeats is listed once; an empty documents table gives no rows, an empty benchmark no
hits; other columns are ignored or, in decontaminate(), kept whatever their names; contamination()
replaces columns named n_words, spans or items. Long texts are indexed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, table, written

WINDOW = 10
SAMPLE = 8
#: Lower-cases A-Z and turns every ASCII character that isn't a letter or digit into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_AT = re.compile(rb"[^\x20]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Windows:
    """The benchmark's distinct windows as word numbers, and the items that hold each."""

    def __init__(self, items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> None:
        self.vocab: dict[bytes, int] = {}
        self.names, numbers, owners, texts = [], {}, [], []
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                texts.append(ids)
                owners.append(-1 if item is None else numbers.setdefault(str(item), len(numbers)))
        self.names = list(numbers)
        cuts = [np.lib.stride_tricks.sliding_window_view(t, min(window, len(t))) for t in texts]
        n = sum(map(len, cuts))
        all_ = np.zeros((n, window), np.int32)  # shorter windows end in zeros, which are no words
        at = 0
        for c in cuts:
            all_[at : at + len(c), : c.shape[1]] = c
            at += len(c)
        owner = np.repeat(np.array(owners, np.int64), [len(c) for c in cuts])
        self.words, which = np.unique(all_, axis=0, return_inverse=True)
        self.lengths = (self.words > 0).sum(axis=1)
        pairs = np.unique(np.stack((which.reshape(-1), owner)), axis=1)
        pairs = pairs[:, pairs[1] >= 0]
        self.owner, self.first = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.words) + 1))
        self.least = int(self.lengths.min(initial=window))

    def owners(self, k: int) -> list[str]:
        return [self.names[i] for i in self.owner[self.first[k] : self.first[k + 1]]]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. A suffix that ends first comes first."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:]
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(np.diff(key[order]) != 0)))
        rank, k = new, 2 * k
        if rank.max() == n or k >= n:
            return order


class FMIndex:
    """Counts and locates word sequences in a text of word numbers (0: a separator)."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        text = np.append(text, 0)  # every suffix then ends at a separator
        n = len(text)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n, self.starts = n, np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.sampled = (sa % SAMPLE == 0) | (bwt == 0)  # no walk steps over a separator
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = sa[self.sampled]
        self.bwt_at = bwt

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(before), before.copy()
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k)) & 1
            low_1, high_1 = ones[low], ones[high]
            low = np.where(bit, zeros + low_1, low - low_1)
            high = np.where(bit, zeros + high_1, high - high_1)
        return high - low

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each sequence."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for back in range(1, words.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            c = words[live, lengths[live] - back]
            low[live] = self.starts[c] + self.rank(c, low[live])
            high[live] = self.starts[c] + self.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows, left = rows.copy(), np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            hit = left[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            left = left[~done]
            c = self.bwt_at[rows[left]]
            rows[left] = self.starts[c] + self.rank(c, rows[left])
            steps[left] += 1
        return out


def shard_hits(texts: list[str | None], w: Windows) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For each text of a shard: its number of words, the removal spans, the items that occur."""
    counts: list[int] = []
    kept: list[np.ndarray] = []
    doc_at: list[np.ndarray] = []
    word_at: list[np.ndarray] = []
    get = w.vocab.get
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        ids = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        if not len(ids):
            continue
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        first, last = edge[::2], edge[1::2]
        for a, b in zip(first[last - first >= w.least], last[last - first >= w.least], strict=True):
            kept.append(np.append(ids[a:b], 0))
            doc_at.append(np.full(b - a + 1, d))
            word_at.append(np.arange(a, b + 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if not kept or not len(w.lengths):
        return counts, spans, items
    text, docs, places = np.concatenate(kept), np.concatenate(doc_at), np.concatenate(word_at)
    index = FMIndex(text, len(w.vocab))
    low, high = index.search(w.words, w.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return counts, spans, items
    which = np.repeat(found, (high - low)[found])
    at = index.locate(np.concatenate([np.arange(low[k], high[k]) for k in found]))
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + w.lengths[which], -1)
    hit = np.concatenate(([0], (np.cumsum(step)[:-1] > 0).view(np.int8), [0]))
    edge = np.flatnonzero(np.diff(hit))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        spans[docs[a]].append((int(places[a]), int(places[b - 1]) + 1))
    for d, k in np.unique(np.stack((docs[at], which)), axis=1).T:
        items[d].extend(w.owners(k))
    return counts, spans, [sorted(set(x)) for x in items]


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that cover what either list covers, in order, none touching another."""
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between those of a span."""
    raw = text.encode()
    at = [m.span() for m in WORD_AT.finditer(raw.translate(FOLD))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[DataFrame]:
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total * 2 // block_bytes) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    return [rows.where(part == k) if n > 1 else rows for k in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = 8 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs, or its columns `keep`, with n_words, spans (words, end exclusive) and items (ids as sorted strings)."""
    session = docs.sparkSession
    every = [f for f in docs.schema.fields if f.name not in ("n_words", "spans", "items")]
    kept = [f for f in every if keep is None or f.name in keep]
    out = docs.select(*[f"`{f.name}`" for f in every if f in kept or f.name == text_col])
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        shared = session.sparkContext.broadcast(Windows(((r.item, r.text) for r in block.toLocalIterator()), window))
        own = kept if last else [f for f in every if f in kept or f.name == text_col]
        schema = T.StructType(
            [
                *own,
                T.StructField("n_words", T.LongType()),
                T.StructField("spans", SPANS),
                T.StructField("items", T.ArrayType(T.StringType())),
            ]
        )

        def run(batches: Iterator[pa.RecordBatch], shared=shared, own=own, again=k > 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                counts, spans, items = shard_hits(b.column(text_col).to_pylist(), shared.value)
                if again:
                    before = [[(s["start"], s["end"]) for s in x] for x in b.column("spans").to_pylist()]
                    spans = [merged(x, y) for x, y in zip(before, spans, strict=True)]
                    items = [sorted({*x, *y}) for x, y in zip(b.column("items").to_pylist(), items, strict=True)]
                pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(f.name) for f in own],
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pair)),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*[f.name for f in own], "n_words", "spans", "items"],
                )

        before, out = out, out.mapInArrow(run, schema)
        if not last:
            out = written(out, "contamination")
            shared.destroy()
            if k:
                delete(before)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "cut", text_col: str = "text", **options) -> DataFrame:
    """docs without the benchmark's passages: action "cut" removes the spans, "drop" the documents."""
    names = docs.columns
    text = f"c{names.index(text_col)}"
    found = contamination(docs.toDF(*[f"c{k}" for k in range(len(names))]), benchmark, text, **options)
    if action == "drop":
        return found.where(F.size("spans") == 0).drop("n_words", "spans", "items").toDF(*names)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [t if t is None or not len(s) else cut_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(text, spans, strict=True)]
        )

    return found.withColumn(text, cut(F.col(text), F.col("spans"))).drop("n_words", "spans", "items").toDF(*names)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
hits AS (SELECT g.rid, g.i, g.n, win.item_id FROM (SELECT rid, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM dg) g JOIN win ON g.n = win.n AND g.s = win.s),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)"""
