"""Mixing sources to target weights by Pareto order sampling.

Within a source a document of b bits of size (its size's binary digits) is wanted min(most, level * b)
times, with the level at which these times the sizes add up to the source's target. The whole part
is certain: that many copies. The rest p is the document's inclusion probability, different between
size classes and sources. A source's documents are ranked together by (u / (1-u)) / (p / (1-p)), random
odds over inclusion odds, and taken in that order until the source's remaining words are reached; the
document at the border is taken if that comes nearer. So the sample's size in words is fixed, to within
half of one document. u comes from a SHA-256 of seed, id and size: reruns agree.

No source is ever sorted as a whole, so one that holds a third of all rows doesn't make one large
task: words are summed in 256 bins of the rank (partial sums before the shuffle), the border bin in
256 finer ones, and only documents in the border's finer bin are ranked one by one, about 1/65536 of
a source. DataFrame functions only. The table of sources, one row each, is ordered in one task.

Defined results: a null text has 0 words and is never taken; a null source is a source, the last; a row
with a null id is told from others by its text; rows that repeat id and size tie and their order doesn't
matter, since they are equal; an empty table gives no rows; a source without words has target 0; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

BINS = 256
WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with each source's target.

    All targets sum to share times all sizes. They are the weights' shares, stopped at most times the
    source's size, the excess going to the others by weight: sources stop in order of size over
    weight, so the k-th row's level, what is left for it and all later rows over their weights, is
    final at the first row that it doesn't stop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (nth + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("long")).withColumn("k", F.row_number().over(by_stop))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    rows = rows.withColumn("before", F.sum("source_size").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("w_before", F.sum("w").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)))
    left = F.lit(share) * F.col("total") - F.lit(most) * F.coalesce("before", F.lit(0))
    rows = rows.withColumn("left", left).withColumn("w_left", F.col("all_w") - F.coalesce("w_before", F.lit(0)))
    cap = F.lit(most) * F.col("source_size")
    free = F.col("left") * F.col("w") / F.col("w_left") <= cap
    rows = rows.withColumn("first", F.min(F.when(free, F.struct("k", "left", "w_left"))).over(everything))
    target = F.when(
        F.col("k") >= F.col("first.k"), F.col("first.left") * F.col("w") / F.col("first.w_left")
    ).otherwise(cap)
    return rows.select("source", "source_size", target.alias("target"))


def unit(key: Column) -> Column:
    """A number between 0 and 1 from the SHA-256 of key, of 52 bits."""
    bits = F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def bin_of(rank: Column, level: int) -> Column:
    """The rank's bin at a level; each bin of a level holds BINS of the next."""
    whole = F.floor(rank / (1 + rank) * float(BINS**level))
    return F.least(whole, F.lit(BINS**level - 1)).cast("long")


def border(rows: DataFrame, bins: Column, start: Column) -> DataFrame:
    """By source: the bin in which the words, in rank order from start, reach the rest wanted; the words before it."""
    sums = rows.groupBy("source", bins.alias("bin")).agg(
        F.sum("size").alias("n"), F.first(start).alias("start"), F.first("rest").alias("rest")
    )
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(run), F.lit(0)))
    return sums.where("before < rest").groupBy("source").agg(F.max(F.struct("bin", "before")).alias("at"))


def same_source(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def size_class(size: Column) -> Column:
    """The number of binary digits of a size; 0 for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0)


def inclusion(rows: DataFrame, wanted: DataFrame, most: float = 2.0) -> DataFrame:
    """Per source and size class (source, class): source_size, target, whole (certain copies), p and the source's rest of words.

    Classes reach `most` in order of size, so with classes from the largest on, the level that the k-th
    row gives, what is left over what weighs, is final at the first class that it doesn't stop.
    """
    classes = rows.groupBy("source", size_class(F.col("size")).alias("class")).agg(F.sum("size").alias("words"))
    classes = classes.alias("c").join(wanted.alias("t"), same_source("c", "t")).select("c.*", "source_size", "target")
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    up = Window.partitionBy("source").orderBy("class")
    whole = Window.partitionBy("source")
    upto = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    classes = classes.withColumn("before", F.coalesce(F.sum("words").over(upto(down, -1)), F.lit(0)))
    classes = classes.withColumn("weight", F.sum(F.col("words") * F.col("class")).over(upto(up, 0)))
    level = F.when(F.col("weight") > 0, (F.col("target") - F.lit(most) * F.col("before")) / F.col("weight"))
    classes = classes.withColumn("level", level)
    free = F.col("level") * F.col("class") <= F.lit(most)
    classes = classes.withColumn("final", F.max(F.when(free, F.struct("class", "level"))).over(whole))
    mean = F.when(F.col("class") <= F.col("final.class"), F.col("final.level") * F.col("class")).otherwise(F.lit(most))
    classes = classes.withColumn("mean", F.when(F.col("class") > 0, mean).otherwise(0.0))
    classes = classes.withColumn("whole", F.floor("mean").cast("long")).withColumn("p", F.col("mean") - F.col("whole"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole)
    return classes.select("source", "class", "source_size", "target", "whole", "p", rest.alias("rest"))


def pareto_take(rows: DataFrame, wanted: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (id, who, source, size) with source_size, target and copies, how often the mix takes the row.

    wanted: (source, source_size, target). who tells rows apart, as text.
    """
    plan = written(inclusion(rows, wanted), "mix-inclusion")
    same_class = same_source("r", "t") & (size_class(F.col("r.size")) == F.col("t.class"))
    joined = rows.alias("r").join(plan.alias("t"), same_class).select("r.*", "source_size", "target", "whole", "p", "rest")
    u = unit(F.concat_ws("|", F.lit(seed), "who", F.col("size")))
    rank = F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    ranked = joined.withColumn("rank", rank)
    open_ = ranked.where("rank is not null")

    coarse = border(open_, bin_of(F.col("rank"), 1), F.lit(0)).select("source", F.col("at.bin").alias("bin1"), F.col("at.before").alias("before1"))
    inner = open_.alias("r").join(coarse.alias("c"), same_source("r", "c")).where(bin_of(F.col("rank"), 1) == F.col("bin1"))
    fine = border(inner.select("r.*", "before1"), bin_of(F.col("rank"), 2), F.col("before1"))
    borders = coarse.alias("c").join(fine.alias("f"), same_source("c", "f")).select(
        "c.source", F.col("at.bin").alias("border"), F.col("at.before").alias("before")
    )
    borders = written(borders, "mix-borders")

    placed = ranked.alias("r").join(borders.alias("b"), same_source("r", "b"), "left").select("r.*", "border", "before")
    place = bin_of(F.col("rank"), 2)
    at_border = F.coalesce(place == F.col("border"), F.lit(False))
    extra = F.coalesce((place < F.col("border")).cast("long"), F.lit(0).cast("long"))
    away = placed.where(~at_border).withColumn("copies", F.col("whole") + extra)
    run = Window.partitionBy("source").orderBy("rank", "who", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.where(at_border).withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    taken = (F.col("so_far") < F.col("rest")) & (F.col("so_far") + F.col("size") / 2 <= F.col("rest"))
    near = near.withColumn("copies", F.col("whole") + taken.cast("long")).drop("so_far")
    return away.unionByName(near).drop("who", "whole", "p", "rest", "rank", "border", "before")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", keep: tuple[str, ...] = (), **shares
) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies; keep: more columns of docs, such as a key of its rows, named unlike these."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    rows = written(docs.select(F.col(id_col).alias("id"), who.alias("who"), F.col(source_col).alias("source"), size.alias("size"), *keep), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return pareto_take(rows, written(targets(sizes, **shares), "mix-targets"), seed)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS who, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s),
k AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
        coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
l AS (SELECT *, 1.5::DOUBLE * total::DOUBLE - 2.0::DOUBLE * before::DOUBLE AS lft, (all_w - w_before)::DOUBLE AS w_left FROM k),
f AS (SELECT k AS fk, lft AS fl, w_left AS fw FROM l WHERE lft * w / w_left <= 2.0::DOUBLE * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN k >= fk THEN fl * w / fw ELSE 2.0::DOUBLE * source_size END AS target FROM l, f),
cl AS (SELECT source, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS cls, sum(size)::BIGINT AS words FROM d GROUP BY ALL),
cw AS (SELECT cl.*, source_size, target, coalesce(sum(words) OVER (PARTITION BY cl.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(words * cls) OVER (PARTITION BY cl.source ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight
      FROM cl JOIN t ON cl.source IS NOT DISTINCT FROM t.source),
lv AS (SELECT *, CASE WHEN weight > 0 THEN (target - 2.0::DOUBLE * before::DOUBLE) / weight::DOUBLE END AS level FROM cw),
fn AS (SELECT *, max(CASE WHEN level * cls <= 2.0::DOUBLE THEN cls END) OVER (PARTITION BY source) AS fc FROM lv),
fl AS (SELECT *, max(CASE WHEN cls = fc THEN level END) OVER (PARTITION BY source) AS flevel FROM fn),
me AS (SELECT *, CASE WHEN cls = 0 THEN 0.0::DOUBLE WHEN cls <= fc THEN flevel * cls ELSE 2.0::DOUBLE END AS mean FROM fl),
wh AS (SELECT *, floor(mean)::BIGINT AS whole, mean - floor(mean) AS p FROM me),
p AS (SELECT source, cls, source_size, target, whole, p, target - (sum(whole * words) OVER (PARTITION BY source))::DOUBLE AS rest FROM wh),
u AS (SELECT d.doc_id, d.who, d.source, d.size, source_size, target, whole, p, rest,
        (('0x' || substr(sha256('mix|' || who || '|' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND cls = CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END),
r AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM u),
c AS (SELECT *, coalesce(sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY source ORDER BY rank NULLS LAST, who, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS so_far FROM r)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN rank IS NOT NULL AND so_far < rest AND so_far + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c"""
