"""Quality classifier by co-training a text view and a metadata view.

The text view is the hashed words, word pairs and word shapes of the whole text (a shape with its share
of the words) and a few measures of repetition. The metadata view is language, source and both together;
nothing in it comes from the text. Two things are judged alike: quality, and not being toxic.

Each view is a naive Bayes classifier of what a document holds, so its fit is a table of counts. In every
round both views judge all documents without a label, in one pass; what one is sure of (calibrated
probability beyond CONFIDENT) is counted, at weight PSEUDO, for the other view. The views are calibrated
on a fold of labelled documents that is never counted: a regression on the log odds that the view's kinds
of features give, each within MOST, so that a long text's many words don't outvote its shapes (for a
view of one kind it is Platt scaling). A last regression on the calibrated log odds weighs the views, so
that a view that tells nothing weighs nothing. A document is kept if its scores of quality and of cleanness both reach the threshold.

Bounds: labels of at most `sample` documents are used (20,000 unless set otherwise), those with the least
hashes of their ids, a third of them for calibration. The text view knows the TERMS features for each
judgement that tell its labelled documents apart best, of chi-square TELLING or more and held by two of
them at least. All documents without a label take part in every round: features are extracted once to a
table of short rows, and a round sends counts of known features to the driver, never rows.

Defined results: a null or empty text holds one feature that says so; null metadata is a value like any
other; rows without an id are judged like others; a document with several labels is good if none
denies it, toxic if one says so; a labelled id that repeats counts once, with its least text; labels that
are null or without a document are left out; a judgement without labels of both kinds in the fold that is
counted gives all documents the score 1; repeated rows each give a row; an empty table gives no rows.
Other columns are kept; columns named like the scores are replaced in with_scores().
"""

from __future__ import annotations

import functools
import math
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, table, written
from .minhash import scatter

SAMPLE = 20_000
ROUNDS = 3
CONFIDENT = 0.98
PSEUDO = 0.3
TERMS = 1024
TELLING = 20.0
META = 4096
MOST = 12.0
#: The kinds of text features, held in the lowest bits of their hashes.
WORDS, PAIRS, SHAPES, MEASURES = range(4)
JUDGEMENTS = ("quality", "clean")
SCORES = ("text_score", "metadata_score", "quality_score", "clean_score")

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
AGAIN = re.compile(r"(.)\1+")
PUNCTUATION = string.punctuation
HASH = xxhash.xxh3_64_intdigest


def shape(token: str) -> str:
    """Runs of letters as a (or A in capitals), digits as 9, other characters once each."""
    letters = LETTERS.sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", token)
    return AGAIN.sub(r"\1", DIGITS.sub("9", letters))[:8]


class Tokens(dict):
    """Small numbers for tokens, with the hashes of their words and shapes; forgotten beyond a bound."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.most, self.words, self.shapes, self.seen = most, array("Q"), array("Q"), {}

    def __missing__(self, token: str) -> int:
        at = len(self)
        core = token.strip(PUNCTUATION)
        if core.isalpha():  # the same as below, without regular expressions
            letters = "A" if len(core) > 1 and core.isupper() else "a"
            self.words.append(HASH(core.lower()))
            first = token.index(core) if len(core) < len(token) else 0
            key = token[:first] + letters + token[first + len(core) :]
        else:
            self.words.append(HASH(EDGES.sub("", token.lower())))
            key = token
        h = self.seen.get(key)
        if h is None:
            h = self.seen[key] = HASH(shape(key)) ^ 0x5A5A5A5A
        self.shapes.append(h)
        self[token] = at
        return at

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the tokens' words and shapes."""
        words, shapes = [], []
        for low in range(0, len(tokens), self.most // 2):
            part = tokens[low : low + self.most // 2]
            if len(self) + len(part) > self.most:
                self.clear()
                self.words, self.shapes, self.seen = array("Q"), array("Q"), {}
            at = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            words.append(np.frombuffer(self.words, np.uint64)[at])
            shapes.append(np.frombuffer(self.shapes, np.uint64)[at])
        return np.concatenate(words), np.concatenate(shapes)


@functools.lru_cache(1 << 16)
def measure(name: str, value: object) -> int:
    return HASH(f"{name} {value}")


def of_kind(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (hashes & ~np.uint64(3)) | np.uint64(kind)


def halvings(share: float) -> int:
    """0 for a share over a half, 1 over a quarter, ...; 9 for none."""
    return min(8, int(-math.log2(share))) if share > 0 else 9


def text_features(text: str | None, tokens: Tokens) -> np.ndarray:
    """Hashes of what the text holds, with repeats."""
    parts = text.split() if text else []
    n = len(parts)
    if not n:
        return of_kind(np.array([HASH("empty")], np.uint64), MEASURES)
    words, shapes = tokens.of(parts)
    kinds, counts = np.unique(shapes, return_counts=True)
    bins = np.minimum(8, -np.log2(counts / n)).astype(np.uint64)
    lines = text.split("\n")
    measures = {
        "repeated words": halvings(float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0),
        "repeated lines": halvings(1 - len(set(lines)) / len(lines)),
        "distinct words": halvings(len(np.unique(words)) / n),
        "word length": min(40, len(text) // n),
    }
    measured = np.array([measure(k, v) for k, v in measures.items()], np.uint64)
    pairs = scatter(words[:-1] * np.uint64(3) + words[1:])
    groups = (words, pairs, scatter(kinds + bins), measured)
    return np.concatenate([of_kind(h, k) for k, h in enumerate(groups)])


def metadata_features(lang: str | None, source: str | None) -> list[int]:
    return [measure("lang", lang) % META, measure("source", source) % META, HASH(f"both {lang} {source}") % META]


class Logistic:
    """Logistic regression with a small ridge on standardised features, by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(std > 1e-9, std, 1.0)
        z = np.column_stack((np.ones(len(x)), (x - self.mean) / self.scale))
        keep = ridge * np.eye(z.shape[1])
        keep[0, 0] = 1e-6
        self.b = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.b, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ self.b)
            self.b += np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-8:
                break

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.b[0] + ((x - self.mean) / self.scale) @ self.b[1:], -30, 30)


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


class Held:
    """For each of many rows the numbers of the features it holds."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(blobs), np.uint16).astype(np.int64)
        self.row = np.repeat(np.arange(len(blobs)), [len(b) // 2 for b in blobs])
        self.n = len(blobs)

    def sums(self, weights: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """For each row and kind of features the sum of its features' weights."""
        n = int(kinds.max(initial=0)) + 1
        return np.bincount(self.row * n + kinds[self.flat], weights[self.flat], self.n * n).reshape(self.n, n)

    def counts(self, rows: np.ndarray, size: int) -> np.ndarray:
        """How many of the rows (a mask) hold each feature; last, how many rows there are."""
        held = np.bincount(self.flat[rows[self.row]], minlength=size)
        return np.append(held, rows.sum()).astype(float)


class Bayes:
    """Weights of features from their counts (see Held.counts) in both classes; only those of mask weigh."""

    def __init__(self, counts: np.ndarray, mask: np.ndarray, kinds: np.ndarray) -> None:
        share = np.log((counts[:, :-1] + 0.5) / (counts[:, -1:] + 1))
        self.weights, self.kinds = np.where(mask, share[1] - share[0], 0.0), kinds

    def odds(self, held: Held) -> np.ndarray:
        return np.clip(held.sums(self.weights, self.kinds), -MOST, MOST)


class Judge:
    """One judgement: two views, their calibration and their joint weight, over labelled rows."""

    def __init__(self, views: tuple[Held, Held], y: np.ndarray, held_out: np.ndarray, masks: tuple[np.ndarray, np.ndarray], kinds: tuple[np.ndarray, np.ndarray]) -> None:
        known = y >= 0
        self.views, self.y, self.masks, self.kinds = views, y, masks, kinds
        self.held_out = known & held_out
        if len(set(y[self.held_out])) < 2:
            self.held_out = known
        counted = known & ~held_out
        self.own = [np.stack([v.counts(counted & (y == k), len(m)) for k in (0, 1)]) for v, m in zip(views, masks, strict=True)]
        self.able = min(self.own[0][:, -1]) > 0

    def fit(self, extra: list[np.ndarray]) -> None:
        self.bayes = [Bayes(own + PSEUDO * more, m, k) for own, more, m, k in zip(self.own, extra, self.masks, self.kinds, strict=True)]
        odds = [b.odds(v) for b, v in zip(self.bayes, self.views, strict=True)]
        at, y = self.held_out, self.y[self.held_out].astype(float)
        self.scaled = [Logistic(o[at], y) for o in odds]
        calibrated = np.column_stack([s.odds(o[at]) for s, o in zip(self.scaled, odds, strict=True)])
        self.joint = Logistic(calibrated, y)

    def scores(self, views: tuple[Held, Held]) -> list[np.ndarray]:
        """Calibrated probabilities: by text, by metadata, by both."""
        odds = [s.odds(b.odds(v)) for s, b, v in zip(self.scaled, self.bayes, views, strict=True)]
        return [probability(o) for o in (*odds, self.joint.odds(np.column_stack(odds)))]

    def bare(self) -> Judge:
        """The judge without the rows that it was fitted on, as tasks need it."""
        out = Judge.__new__(Judge)
        out.able, out.bayes, out.scaled, out.joint = self.able, self.bayes, self.scaled, self.joint
        return out


class CoTrained:
    """The features known and the two judges (None where labels can't tell); see SCORES."""

    def __init__(self, known: np.ndarray, judges: list[Judge | None]) -> None:
        self.known, self.judges = known, judges
        self.likely = np.zeros(1 << 16, bool)
        self.likely[(known >> np.uint64(48)).astype(np.int64)] = True

    def extract(self, text: str | None, tokens: Tokens) -> bytes:
        """The numbers of the known features that a text holds."""
        if not len(self.known):
            return b""
        h = text_features(text, tokens)
        h = h[self.likely[(h >> np.uint64(48)).astype(np.int64)]]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return np.unique(at[self.known[at] == h]).astype(np.uint16).tobytes()

    def scores(self, a: list[bytes], b: list[bytes]) -> list[np.ndarray]:
        views = Held(a), Held(b)
        one = np.ones(len(a))
        quality, clean = (j.scores(views) if j else [one] * 3 for j in self.judges)
        return [*quality, clean[2]]


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(id, quality, clean, held_out, text, lang, source) of at most `sample` documents with a label; judgements are 1, 0 or null."""
    for c in ("quality", "toxic"):
        if c not in labels.columns:
            labels = labels.withColumn(c, F.lit(None).cast("int"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.min((F.col("quality") > 0).cast("int")).alias("quality"), F.min((F.col("toxic") <= 0).cast("int")).alias("clean")
    )
    known = known.where("quality is not null or clean is not null")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = known.withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(3)) == 2)
    rows = docs.select("doc_id", F.struct("text", "lang", "source").alias("row")).join(F.broadcast(known), "doc_id")  # at most `sample` rows
    one = rows.groupBy("doc_id", "quality", "clean", "held_out").agg(F.min("row").alias("row"))
    return written(one.select(F.col("doc_id").alias("id"), "quality", "clean", "held_out", "row.*"), "labelled")


def telling(rows: DataFrame) -> dict[str, list[int]]:
    """For each judgement the hashes of the text features that tell the counted documents of labelled() apart best."""
    rows = rows.where("not held_out").select(*JUDGEMENTS, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            y = [c.fill_null(-1).to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            found = [np.unique(text_features(t.as_py(), tokens)) for t in batch.column(2)]
            if not found:
                continue
            sizes = [len(f) for f in found]
            h, at = np.unique(np.concatenate(found), return_inverse=True)
            cols = [np.bincount(at, np.repeat(v == k, sizes), len(h)).astype(np.int64) for v in y for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, cols)], ["h", "q0", "q1", "c0", "c1"])

    counts = rows.mapInArrow(run, "h long, q0 long, q1 long, c0 long, c1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("q0", "q1", "c0", "c1")])
    counts = written(counts.where("q0 + q1 > 1 or c0 + c1 > 1"), "features")
    sizes = rows.agg(*[F.count(F.when(F.col(j) == k, 1)).cast("double").alias(f"{j[0]}{k}") for j in JUDGEMENTS for k in (0, 1)]).first()
    out = {}
    for j in JUDGEMENTS:
        zero, one = sizes[f"{j[0]}0"], sizes[f"{j[0]}1"]
        out[j] = []
        if zero and one:
            a, b = F.col(f"{j[0]}0").cast("double"), F.col(f"{j[0]}1").cast("double")
            chi = (zero + one) * F.pow(a * (one - b) - b * (zero - a), F.lit(2.0)) / (zero * one * (a + b) * (zero + one - a - b))
            best = counts.where((a + b > 0) & (a + b < zero + one)).select("h", chi.alias("chi")).where(F.col("chi") >= TELLING)
            out[j] = [r.h for r in best.orderBy(F.desc("chi"), "h").limit(TERMS).collect()]
    delete(counts)
    return out


def extracted(docs: DataFrame, model: CoTrained, keep: list[str]) -> DataFrame:
    """The columns named, and the features a and b that each row of docs (with text, lang, source) holds, as binaries."""
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)], "text", "lang", "source")
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            a = [model.extract(t.as_py(), tokens) for t in batch.column(n)]
            b = [np.array(metadata_features(x, y), np.uint16).tobytes() for x, y in zip(*(batch.column(n + k).to_pylist() for k in (1, 2)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(a, pa.binary()), pa.array(b, pa.binary())], [*batch.schema.names[:n], "a", "b"])

    types = ", ".join(f"k{k} {rows.schema[f'k{k}'].dataType.simpleString()}" for k in range(n))
    out = rows.mapInArrow(run, f"{types}, a binary, b binary")
    return out.select(*[F.col(f"k{k}").alias(c) for k, c in enumerate(keep)], "a", "b")


def agreed(pool: DataFrame, judges: list[Judge | None], sizes: tuple[int, int]) -> list[list[np.ndarray]]:
    """For each judge and view the counts, by class, of the documents of the pool that the other view is sure of."""
    bare = [j.bare() if j else None for j in judges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 2, 2, max(sizes) + 1))
        for batch in batches:
            views = tuple(Held(c.to_pylist()) for c in batch.columns[2:])
            for j, judge in enumerate(bare):
                if judge is None:
                    continue
                unknown = ~batch.column(j).to_numpy(zero_copy_only=False).astype(bool)
                for v, p in enumerate(judge.scores(views)[:2]):
                    for k, sure in enumerate((p < 1 - CONFIDENT, p > CONFIDENT)):
                        got = views[1 - v].counts(sure & unknown, sizes[1 - v])
                        sums[j, 1 - v, k, : len(got) - 1] += got[:-1]
                        sums[j, 1 - v, k, -1] += got[-1]
        j, v, k, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (j, v, k, at)] + [pa.array(sums[j, v, k, at])], ["j", "v", "k", "at", "n"])

    got = pool.select("knows_quality", "knows_clean", "a", "b").mapInArrow(run, "j int, v int, k int, at int, n double")
    total = np.zeros((2, 2, 2, max(sizes) + 1))
    for r in got.groupBy("j", "v", "k", "at").agg(F.sum("n").alias("n")).collect():  # at most 8 * (2 * TERMS + META) rows
        total[r.j, r.v, r.k, r["at"]] = r.n
    return [[np.column_stack((total[j, v, :, : sizes[v]], total[j, v, :, -1])) for v in (0, 1)] for j in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, keep: list[str] | None = None) -> tuple[CoTrained, DataFrame | None]:
    """The classifier, and the table of features of all documents (with the columns to keep) if it was needed."""
    rows = labelled(docs, labels, sample)
    best = telling(rows)
    known = np.unique(np.array(best["quality"] + best["clean"], np.int64).view(np.uint64))
    model = CoTrained(known, [None, None])
    lab = extracted(rows, model, ["id", *JUDGEMENTS, "held_out"]).orderBy("id").toArrow()
    views = Held(lab["a"].to_pylist()), Held(lab["b"].to_pylist())
    held_out = lab["held_out"].to_numpy().astype(bool)
    sizes = len(known), META
    judges: list[Judge | None] = []
    for j in JUDGEMENTS:
        mask = np.isin(known, np.array(best[j], np.int64).view(np.uint64)), np.ones(META, bool)
        kinds = (known & np.uint64(3)).astype(np.int64), np.zeros(META, np.int64)
        judge = Judge(views, pc.fill_null(lab[j], -1).to_numpy(), held_out, mask, kinds)
        judges.append(judge if judge.able else None)
    none = [[np.zeros((2, s + 1)) for s in sizes]] * 2
    for judge, extra in zip(judges, none, strict=True):
        if judge:
            judge.fit(extra)
    pool = None
    if any(judges):
        # The sample's rows are known by id; they are scored, but aren't part of the pool.
        marks = rows.select(F.col("id").alias("__id"), *[F.col(j).isNotNull().alias(f"knows_{j}") for j in JUDGEMENTS])
        marked = docs.join(F.broadcast(marks), F.col("doc_id") == F.col("__id"), "left")
        marked = marked.withColumns({f"knows_{j}": F.coalesce(f"knows_{j}", F.lit(False)) for j in JUDGEMENTS})
        names = [*(keep or []), *[f"knows_{j}" for j in JUDGEMENTS]]
        pool = written(extracted(marked, model, names), "pool")
        for _ in range(rounds):
            for judge, extra in zip(judges, agreed(pool, judges, sizes), strict=True):
                if judge:
                    judge.fit(extra)
    model.judges = [j.bare() if j else None for j in judges]
    delete(rows)
    return model, pool


def scored_batch(model: CoTrained, a: list[bytes], b: list[bytes], threshold: float) -> list[pa.Array]:
    got = model.scores(a, b)
    return [*map(pa.array, got), pa.array((got[2] >= threshold) & (got[3] >= threshold))]


def score_types(names: list[str], schema) -> str:
    kept = [f"`{c}` {schema[c].dataType.simpleString()}" for c in names]
    return ", ".join([*kept, *[f"{c} double" for c in SCORES], "keep boolean"])


def with_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs with text_score, metadata_score and quality_score (of good quality), clean_score (of not being toxic) and keep."""
    model, pool = fit(docs, labels, **options)
    if pool is not None:
        delete(pool)
    names = [c for c in docs.columns if c not in (*SCORES, "keep")]
    at = [names.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            a = [model.extract(t.as_py(), tokens) for t in batch.column(at[0])]
            b = [np.array(metadata_features(x, y), np.uint16).tobytes() for x, y in zip(*(batch.column(k).to_pylist() for k in at[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *scored_batch(model, a, b, threshold)], [*names, *SCORES, "keep"])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, score_types(names, docs.schema))


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that neither judgement rejects."""
    model, pool = fit(docs, labels, **options)
    if pool is not None:
        delete(pool)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            a = [model.extract(t.as_py(), tokens) for t in batch.column(at[0])]
            b = [np.array(metadata_features(x, y), np.uint16).tobytes() for x, y in zip(*(batch.column(k).to_pylist() for k in at[1:]), strict=True)]
            yield batch.filter(scored_batch(model, a, b, threshold)[-1])

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores come from the table of features that the rounds read, so texts are read for features only once."""
    docs = table(spark, sf_dir, "documents")
    model, pool = fit(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    if pool is None:
        one = [F.lit(1.0).alias(c) for c in SCORES]
        return docs.select("doc_id", *one, F.lit(True).alias("keep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), *scored_batch(model, a, b, 0.5)], ["doc_id", *SCORES, "keep"])

    return pool.select("doc_id", "a", "b").mapInArrow(run, score_types(["doc_id"], docs.schema))
