"""Incremental secret scan over a content-addressed ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger table holds one row
for each (blob, rule version) that was ever scanned, with the spans found. An update hashes the new
versions, scans only the (blob, rule version) pairs that the ledger lacks, one copy of each blob,
and appends them; findings are joined back to all paths that hold the blob. DataFrame functions only.

Defined results: a null text is the empty text; a null id is an id like any other; repeated rows
each get their row back; an empty table gives no rows; other columns are ignored. A text is scanned
whole whatever its length. Copies, a third of all rows or more, are scanned once: the blob keys are
pre-aggregated before they are shuffled, and blobs that hold more than 1 / HOT of all rows, of which
there are less than HOT, are dealt over SALTS keys wherever rows meet by blob. An update's number comes
from the ledger's folder; its paths are recorded last, so an update that died is not there and is done
again by the next one, and pairs that the ledger has are never scanned again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, delete, shared_path, table


@dataclass(frozen=True)
class Rule:
    """A finding is a match of pattern whose group has at least min_chars characters."""

    kind: str
    pattern: str
    group: int
    min_chars: int
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # a run of 16 or more is a whole run of [0-9a-f]
)

SPANS = "array<struct<start:int,end:int>>"
RUN = 256


def walk(items: Column, state: Column, step, kind: str, last=None) -> Column:
    """The values (arrays of type `kind`) that step(state, item) -> (state, values) gives, one behind the other; last(state) behind them.

    Items are taken RUN at a time, so what has been given isn't copied for every item.
    """
    none = F.array().cast(kind)
    runs = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / RUN).cast("int")),
        lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)),
    )

    def one(acc: Column, x: Column) -> Column:
        after, values = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], values).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        # The element of a single array: done is computed once.
        both = F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], F.array(d["out"])).alias("out")))
        return both[0]

    first = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
    end = lambda acc: F.flatten(acc["out"] if last is None else F.concat(acc["out"], F.array(last(acc["state"]))))
    return F.aggregate(runs, first, run, end)


def find_spans(text: Column, rule: Rule) -> Column:
    """Spans (code points, end exclusive) of the rule's findings, in order.

    split() gives the gaps around the matches, so running lengths of gaps and matches are offsets.
    """
    gaps = F.split(text, rule.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    found = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return end, F.when(F.length(x["value"]) >= rule.min_chars, span).otherwise(F.array().cast(SPANS))

    # The gap behind the last match has no match.
    walked = walk(F.slice(found, F.lit(1), F.size(matches)), F.lit(0), step, SPANS)
    return F.when(text.rlike(rule.pattern), walked).otherwise(F.array().cast(SPANS))


class BlobLedger:
    """Findings of every scanned (blob, rule version), and the blob of every path version."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES) -> None:
        self.spark, self.path, self.rules = spark, path, rules
        self.updates = self._recorded()

    def _recorded(self) -> int:
        """The number behind the last update that the folder holds."""
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/paths")
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n.removeprefix("update=")) + 1 for n in names if n.startswith("update=")), default=0)

    def _has_scans(self) -> bool:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scanned")
        return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)

    def _read(self, name: str, like: str) -> DataFrame:
        return self.spark.read.schema(like).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._read("scanned", f"blob string, rule string, spans {SPANS}")

    def update(self, versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Records the versions and scans what is new. Returns the (id, blob) rows of these versions."""
        rows = versions.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        rows = rows.withColumn("blob", F.sha2(F.col("text"), 256))
        kind = rows.select("id", "blob").schema
        pending, at = (f"{self.path}/{folder}/update={self.updates:06d}" for folder in ("pending", "paths"))
        rows.select("id", "blob").write.mode("overwrite").parquet(pending)
        paths = self.spark.read.schema(kind).parquet(pending)

        pairs = paths.groupBy("blob").agg(F.min("id").alias("id"))
        pairs = pairs.withColumn("rule", F.explode(F.array(*[F.lit(r.key) for r in self.rules])))
        if self._has_scans():
            pairs = pairs.join(self.scanned().select("blob", "rule"), ["blob", "rule"], "left_anti")
        unseen = pairs.groupBy("id", "blob").agg(F.collect_set("rule").alias("rules"))

        texts = rows.alias("t").join(
            unseen.alias("u").hint("shuffle_hash"),
            F.col("t.id").eqNullSafe(F.col("u.id")) & (F.col("t.blob") == F.col("u.blob")),
        )
        scans = [
            F.struct(
                F.lit(r.key).alias("rule"),
                F.when(F.array_contains("rules", r.key), find_spans(F.col("text"), r)).alias("spans"),
            )
            for r in self.rules
        ]
        found = texts.select(F.col("t.blob").alias("blob"), F.inline(F.array(*scans)))
        # Rows that repeat id and text were both scanned; the ledger keeps one row.
        found = found.where("spans is not null").groupBy("blob", "rule").agg(F.first("spans").alias("spans"))
        found.write.mode("append").parquet(f"{self.path}/scanned")
        # Only now, so that what the ledger lists as recorded has been scanned.
        paths.write.mode("overwrite").parquet(at)
        delete(pending, self.spark)
        self.updates += 1
        return self.spark.read.schema(kind).parquet(at)

    def findings(self, paths: DataFrame) -> DataFrame:
        """(id, blob, one span array for each rule kind) for every row of paths."""
        ours = self.scanned().where(F.col("rule").isin([r.key for r in self.rules]) & (F.size("spans") > 0))
        by_blob = ours.groupBy("blob").agg(
            *[F.first(F.when(F.col("rule") == r.key, F.col("spans")), ignorenulls=True).alias(r.kind) for r in self.rules]
        )
        none = F.array().cast(SPANS)
        left, right = dealt(paths, by_blob, "blob", "id")
        return left.join(right, ["blob", "_salt"], "left").select(
            "id", "blob", *[F.coalesce(F.col(r.kind), none).alias(r.kind) for r in self.rules]
        )


def spans_text(rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans as kind:start:end, by start and then by the rules' order, comma-joined."""
    def numbered(i: int, r: Rule) -> Column:
        return F.transform(
            F.col(r.kind),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("i"), s["end"].alias("end"), F.lit(r.kind).alias("kind")
            ),
        )

    rows = [numbered(i, r) for i, r in enumerate(rules)]
    return F.array_join(
        F.transform(F.array_sort(F.concat(*rows)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = BlobLedger(spark, shared_path(spark, "secret-ledger"))
    paths = ledger.update(table(spark, sf_dir, "documents"))
    return ledger.findings(paths).withColumn("spans", spans_text()).select(
        F.col("id").alias("doc_id"),
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in RULES],
        F.sha2("spans", 256).alias("base_sha256"),
        "spans",
    )


def redact(versions: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text with its findings' spans replaced by [SECRET]; overlapping spans are one."""
    kinds = [c for c in found.columns if c not in ("id", "blob")]
    hits = found.where(" or ".join(f"size({k}) > 0" for k in kinds)).select(
        F.col("blob").alias("_blob"), F.array_sort(F.concat(*kinds)).alias("_spans")
    ).groupBy("_blob").agg(F.first("_spans").alias("_spans"))
    text = F.col(text_col)

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        piece = F.array(F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("[SECRET]")))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, piece).otherwise(F.array().cast("array<string>"))

    rest = lambda at: F.array(F.substring(text, at + 1, F.length(text)))
    done = F.array_join(walk(F.col("_spans"), F.lit(0), step, "array<string>", rest), "")
    rows = versions.withColumn("_blob", F.sha2(F.coalesce(text, F.lit("")), 256))
    left, right = dealt(rows, hits, "_blob", id_col)
    joined = left.join(right, ["_blob", "_salt"], "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(done)).select(*[f"`{c}`" for c in versions.columns])


ASSIGN_SQL = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
)
OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS (
  SELECT rid, 'assign' AS kind, 0 AS k, 12 AS least, string_split_regex(t, '{ASSIGN_SQL}') AS g,
         regexp_extract_all(t, '{ASSIGN_SQL}') AS m, regexp_extract_all(t, '{ASSIGN_SQL}', 2) AS v FROM d
  UNION ALL
  SELECT rid, 'access', 1, 18, string_split_regex(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL
  SELECT rid, 'hex', 2, 16, string_split_regex(t, '[0-9a-f]{{16,}}'), regexp_extract_all(t, '[0-9a-f]{{16,}}'),
         regexp_extract_all(t, '[0-9a-f]{{16,}}') FROM d),
u AS (SELECT rid, kind, k, least, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM f WHERE len(m) > 0),
s AS (
  SELECT rid, kind, k, length(m[i]) AS n, length(v[i]) >= least AS ok,
         list_sum(list_transform(g[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS a FROM u),
p AS (
  SELECT rid, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
         string_agg(kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT, ',' ORDER BY a, k) AS spans
  FROM s WHERE ok GROUP BY rid)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN p USING (rid)"""
