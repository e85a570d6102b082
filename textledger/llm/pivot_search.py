"""Exact top-k inner product search with a pivot-distance index.

Inner products become distances: with M the largest norm, a vector x gets one more component,
sqrt(M^2 - |x|^2), a query q gets 0, and |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots are k-means
centres of a sample (at most SAMPLE vectors, those with the least hashes of their ids). Every vector
is keyed by its nearest pivot and its distance to it, range-sorted by that key, and packed in blocks
of up to BLOCK rows, so a block is an annulus around a pivot; many equal vectors fill many blocks.
The index is a table.

Queries are packed the same way in groups. The k-th best score within the sample bounds each query's
radius from the start. A group meets only those annuli that |d(q, pivot) - d(x, pivot)| <= radius
allows, in two passes: first its NEAREST ones, whose k-th best scores tighten the radii, then those that
the tightened radii still allow, so that what the bound excludes is never shipped. A task keeps each
query's k best, tightens the radius as it goes, and passes over annuli that it then excludes. In the
second pass a group's annuli are dealt over a few segments, each with its own k best, and a last ranking
joins all. Bounds have a margin for rounding; scores are exact integers.

Defined results: rows without id, without vector, or with a null, NaN or infinite component take no
part; a shorter vector counts as padded with zeros; in op1_topk_search each row of an id that repeats is a
query and a candidate of its own, for its twins too; top_k() itself takes unique ids; fewer than k
candidates are all returned; an empty table gives no rows; other columns are ignored. Scores must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.history import numbered
from .common import table, written

PIVOTS = 32
SAMPLE = 2048
BLOCK = 1024
GROUP = 128
SEGMENTS = 4
NEAREST = 4
MARGIN = 1e-6
FOUND = "query_id long, vec_id long, score long, query_group long, least binary"
FOUND_NAMES = [c.split(" ")[0] for c in FOUND.split(", ")]
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component; null for vectors that take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def matrix(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def column_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dim and (sizes == dim).all():
        return flat.reshape(len(column), dim)
    return matrix(column.to_pylist(), dim)


def distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Between the rows (x, last) and the pivots, which have the last component too."""
    own = (x.astype(float) ** 2).sum(axis=1) + last**2
    d = own[:, None] + (pivots**2).sum(axis=1)[None] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1])
    return np.sqrt(np.maximum(d, 0))


class Fit:
    """Pivots, the largest squared norm, and the sample that bounds radii; at most SAMPLE rows."""

    def __init__(self, ids: list[int], vectors: np.ndarray, top: int, k: int) -> None:
        self.ids, self.vectors, self.top, self.k = np.array(ids, np.int64), vectors, float(top), k
        x = np.column_stack((vectors, self.last(vectors)))
        rng = np.random.RandomState(7)
        centres = x[rng.permutation(len(x))[:PIVOTS]].astype(float)
        for _ in range(6):
            near = distances(vectors, x[:, -1], centres).argmin(axis=1)
            for c in range(len(centres)):
                if (near == c).any():
                    centres[c] = x[near == c].mean(axis=0)
        self.pivots = centres

    def last(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (vectors.astype(float) ** 2).sum(axis=1), 0))

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(vectors, self.last(vectors), self.pivots)
        near = d.argmin(axis=1)
        return near, d[np.arange(len(d)), near]

    def floor_scores(self, ids: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """The k-th best score of each query within the sample; the least number if it has fewer."""
        if len(self.ids) <= self.k:
            return np.full(len(ids), np.iinfo(np.int64).min)
        s = queries @ self.vectors.T
        s[ids[:, None] == self.ids[None]] = np.iinfo(np.int64).min
        return np.partition(s, -self.k, axis=1)[:, -self.k]


def narrow(x: np.ndarray) -> tuple[bytes, str]:
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind).tobytes(), np.dtype(kind).str
    return x.tobytes(), x.dtype.str


def packed(rows: DataFrame, fit, dim: int, most: int, by_pivot: bool) -> DataFrame:
    """rows (id, v) keyed, range-sorted by pivot, distance and id, in blocks of up to `most` rows."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, dist = fit.value.keys(column_matrix(b.column(1), dim))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(dist)], ["id", "v", "pivot", "dist"]
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (pivot, ids, vectors, distances) of the open block
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            ids, v, d = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            raw, kind = narrow(v)
            out = pa.RecordBatch.from_pylist(
                [{"block": seq, "pivot": held[0][0], "low": d.min(), "high": d.max(), "ids": ids.tobytes(), "vectors": raw, "kind": kind}],
                schema=pa.schema(
                    [("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()),
                     ("ids", pa.binary()), ("vectors", pa.binary()), ("kind", pa.string())]
                ),
            )
            seq, held, size = seq + 1, [], 0
            return out

        for b in batches:
            ids, near, dist = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            v = column_matrix(b.column(1), dim)
            at = 0
            while at < len(ids):
                end = min(len(ids), at + most - size)
                if by_pivot:
                    other = np.flatnonzero(near[at:end] != (held[0][0] if held else near[at]))
                    end = at + int(other[0]) if len(other) else end
                if end > at:
                    held.append((int(near[at]), ids[at:end], v[at:end], dist[at:end]))
                    size += end - at
                    at = end
                if size == most or at < len(ids):
                    yield flush()
        if held:
            yield flush()

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.mapInArrow(key, "id long, v array<long>, pivot int, dist double")
    keyed = keyed.repartitionByRange(n, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
    return keyed.mapInArrow(pack, "block long, pivot int, low double, high double, ids binary, vectors binary, kind string")


def unpack(vectors: bytes, kind: str, dim: int) -> np.ndarray:
    return np.frombuffer(vectors, np.dtype(kind)).reshape(-1, dim).astype(np.int64) if dim else np.zeros((0, 0), np.int64)


def annuli(groups: DataFrame, fit, dim: int) -> DataFrame:
    """Of each query group (with least, the scores known to be reached) and pivot: the distances within which an annulus may hold a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = fit.value
        for b in batches:
            for r in b.to_pylist():
                ids, q = np.frombuffer(r["ids"], np.int64), unpack(r["vectors"], r["kind"], dim)
                d = distances(q, np.zeros(len(q)), f.pivots)
                least = f.floor_scores(ids, q)
                if r["least"]:
                    least = np.maximum(least, np.frombuffer(r["least"], np.int64))
                radius = radii(q, least, f.top)
                n = len(f.pivots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)),
                     pa.array((d - radius[:, None]).min(axis=0)), pa.array((d + radius[:, None]).max(axis=0)),
                     pa.array(d.min(axis=0)), pa.array(d.max(axis=0))],
                    ["query_group", "pivot", "inner", "outer", "near", "far"],
                )

    return groups.mapInArrow(run, "query_group long, pivot int, inner double, outer double, near double, far double")


def radii(queries: np.ndarray, scores: np.ndarray, top: float) -> np.ndarray:
    """Distance within which anything with at least that score lies, with a margin."""
    far = scores == np.iinfo(np.int64).min
    square = (queries.astype(float) ** 2).sum(axis=1) + top - 2 * np.where(far, 0, scores).astype(float)
    return np.where(far, np.inf, np.sqrt(np.maximum(square, 0)) * (1 + MARGIN) + MARGIN * np.sqrt(top + 1))


class Best:
    """The k best (score, id) of each query of a group; ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, fit: Fit, least: bytes | None = None) -> None:
        self.ids, self.q, self.fit, self.k = ids, queries, fit, fit.k
        self.d = distances(queries, np.zeros(len(queries)), fit.pivots)
        self.least = fit.floor_scores(ids, queries)
        if least:
            self.least = np.maximum(self.least, np.frombuffer(least, np.int64))
        self.size = float(np.abs(queries).max(initial=0)) * queries.shape[1]
        self.who, self.score, self.vec = (np.empty(0, np.int64) for _ in range(3))

    def meet(self, pivot: int, low: float, high: float, ids: np.ndarray, vectors: np.ndarray) -> None:
        d, r = self.d[:, pivot], radii(self.q, self.least, self.fit.top)
        open_ = np.flatnonzero((low - r <= d) & (d <= high + r))
        if not len(open_):
            return
        exact = self.size * float(np.abs(vectors).max(initial=0)) < 2**53
        kind = np.float64 if exact else np.int64
        s = (self.q[open_].astype(kind) @ vectors.T.astype(kind)).astype(np.int64)
        a, b = np.nonzero((s >= self.least[open_][:, None]) & (ids[None] != self.ids[open_][:, None]))
        who = np.concatenate((self.who, open_[a]))
        score, vec = np.concatenate((self.score, s[a, b])), np.concatenate((self.vec, ids[b]))
        order = np.lexsort((vec, -score, who))
        who, score, vec = who[order], score[order], vec[order]
        first = np.searchsorted(who, np.arange(len(self.ids)))
        place = np.arange(len(who)) - first[who]
        full = who[place == self.k - 1]
        self.least[full] = np.maximum(self.least[full], score[place == self.k - 1])
        self.who, self.score, self.vec = (x[place < self.k] for x in (who, score, vec))

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[self.who]), pa.array(self.vec), pa.array(self.score)], ["query_id", "vec_id", "score"]
        )

    def reached(self, group: int) -> pa.RecordBatch:
        """The k-th best scores so far, as a row of their own."""
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array([group]), pa.array([self.least.tobytes()])], FOUND_NAMES)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner products for each query.

    Both have (id long, v array<long>).
    """
    session = vectors.sparkSession
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    top, dim = vectors.agg(F.max(square), F.max(F.size("v"))).first()
    if top is None or not dim:
        return session.createDataFrame([], RESULT)
    sample = vectors.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).collect()
    fit = session.sparkContext.broadcast(Fit([r.id for r in sample], matrix([r.v for r in sample], dim), top, k))
    index = written(packed(vectors, fit, dim, BLOCK, True), "pivot-index")
    groups = written(packed(queries, fit, dim, GROUP, False), "query-groups")

    places = index.select("block", "pivot", "low", "high")
    gap = F.greatest(F.col("low") - F.col("far"), F.col("near") - F.col("high"), F.lit(0.0))

    def allowed(least: DataFrame) -> DataFrame:
        """(query_group, block, gap) of the annuli that may hold a result, given least (query_group, least)."""
        known = groups.join(least.withColumnRenamed("query_group", "block"), "block", "left")
        pairs = places.join(annuli(known, fit, dim), "pivot").where("high >= inner and low <= outer")
        return pairs.select("query_group", "block", gap.alias("gap"))

    def searched(pairs: DataFrame, least: DataFrame) -> DataFrame:
        """FOUND of pairs (query_group, block, gap, segment)."""
        queries_of = groups.select(F.col("block").alias("query_group"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("kind").alias("q_kind"))
        queries_of = queries_of.join(least, "query_group", "left")
        work = pairs.join(index, "block").join(queries_of, "query_group")
        work = work.repartition("query_group", "segment").sortWithinPartitions("query_group", "segment", "gap", "block")
        return work.mapInArrow(search, FOUND)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def done() -> Iterator[pa.RecordBatch]:
            rows = best.rows()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.nulls(rows.num_rows, pa.int64()), pa.nulls(rows.num_rows, pa.binary())], FOUND_NAMES)
            yield best.reached(now[0])

        for b in batches:
            for cells in zip(*b.columns, strict=True):  # a block at a time
                r = {n: c.as_py() for n, c in zip(b.schema.names, cells, strict=True)}
                if (r["query_group"], r["segment"]) != now:
                    if best is not None:
                        yield from done()
                    now = r["query_group"], r["segment"]
                    best = Best(np.frombuffer(r["q_ids"], np.int64), unpack(r["q_vectors"], r["q_kind"], dim), fit.value, r["least"])
                best.meet(r["pivot"], r["low"], r["high"], np.frombuffer(r["ids"], np.int64), unpack(r["vectors"], r["kind"], dim))
        if best is not None:
            yield from done()

    nothing = session.createDataFrame([], "query_group long, least binary")
    by_gap = Window.partitionBy("query_group").orderBy("gap", "block")
    near = allowed(nothing).withColumn("n", F.row_number().over(by_gap)).where(F.col("n") <= NEAREST)
    near = written(near.select("query_group", "block", "gap", F.lit(0).alias("segment")), "near-pairs")
    first = written(searched(near, nothing), "near-found")
    least = written(first.where("least is not null").select("query_group", "least"), "reached")
    rest = allowed(least).join(near, ["query_group", "block"], "left_anti")
    rest = rest.withColumn("segment", F.pmod(F.xxhash64("block"), F.lit(SEGMENTS)).cast("int"))
    found = first.unionByName(searched(rest, least)).where("query_id is not null").select("query_id", "vec_id", "score")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    rows = numbered(rows.where("id is not null and v is not null"), 0, ["id", "v"])
    rows = written(rows.select("seq", F.col("id").alias("vec_id"), "v"), "vectors")
    # In order of ids, so that ties go to the smaller id.
    vectors = rows.select(F.col("seq").alias("id"), "v")
    found = top_k(vectors, rows.where("pmod(vec_id, 20) = 0").select(F.col("seq").alias("id"), "v"))
    names = rows.select("seq", "vec_id")
    found = found.join(names.withColumnRenamed("seq", "query_id").withColumnRenamed("vec_id", "query"), "query_id")
    found = found.withColumnRenamed("vec_id", "seq").join(names, "seq")
    return found.select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


OP1_SQL = """
WITH e AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.n <> c.n WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""
