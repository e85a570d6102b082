"""Queries over calls and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.tables import work_path
from .fixtures import CALLS, calls, table

QUERIES, ORACLES = {}, {}
BUCKET = "least(103, greatest(0, ceil(round(ln(greatest(duration_us, 1)) / ln(1.2), 9))))::INT"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("command_counts", f"WITH {CALLS} SELECT command, outcome, count(*) AS n FROM calls GROUP BY ALL")
def command_counts(spark, d):
    return calls(spark, d).groupBy("command", "outcome").agg(F.count("*").alias("n"))


@query("outcome_totals", f"WITH {CALLS} SELECT command, outcome, count(*) AS n FROM calls GROUP BY GROUPING SETS ((command, outcome), (command), (outcome), ())")
def outcome_totals(spark, d):
    return calls(spark, d).cube("command", "outcome").agg(F.count("*").alias("n"))


@query("outcome_rate", f"WITH {CALLS} SELECT coalesce(avg((outcome = 'conflict')::INT), 0) AS rate FROM calls WHERE command IN ('view', 'click')")
def outcome_rate(spark, d):
    return M.outcome_rate(calls(spark, d).where("command in ('view', 'click')"), "conflict")


HIST = f"hist AS (SELECT command, {BUCKET} AS bucket, count(*) AS n, sum(duration_us)::BIGINT AS total_us, max(duration_us) AS max_us FROM calls GROUP BY ALL)"


@query("latency_histogram", f"WITH {CALLS}, {HIST} SELECT * FROM hist")
def latency_histogram(spark, d):
    return M.histogram(calls(spark, d), "command")


@query("histogram_merge", f"WITH {CALLS}, {HIST} SELECT bucket, sum(n)::BIGINT AS n, sum(total_us)::BIGINT AS total_us, max(max_us) AS max_us FROM hist GROUP BY bucket")
def histogram_merge(spark, d):
    shards = M.histogram(calls(spark, d).withColumn("shard", F.col("call_id") % 8), "shard")
    return M.merged(shards)


@query(
    "histogram_quantile",
    f"""WITH {CALLS}, {HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY command ORDER BY bucket) AS so_far, sum(n) OVER (PARTITION BY command) AS all_n, max(max_us) OVER (PARTITION BY command) AS top FROM hist),
q AS (SELECT r.*, q FROM r, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q)),
m AS (SELECT command, sum(total_us)::DOUBLE / sum(n)::DOUBLE AS mean_us FROM hist GROUP BY command)
SELECT command, q, round(arg_min(CASE WHEN bucket = 103 THEN top ELSE least(pow(1.2::DOUBLE, bucket), top) END, bucket), 6) AS value_us, any_value(mean_us) AS mean_us
FROM q JOIN m USING (command) WHERE so_far >= ceil(q * all_n) GROUP BY command, q""",
)
def histogram_quantile(spark, d):
    return M.quantiles(latency_histogram(spark, d), "command", [0.5, 0.95, 0.99])


@query("exact_percentile", f"WITH {CALLS} SELECT command, quantile_disc(duration_us, 0.5) AS p50, quantile_disc(duration_us, 0.95) AS p95 FROM calls GROUP BY command")
def exact_percentile(spark, d):
    found = M.percentiles(calls(spark, d), "command", "duration_us", [0.5, 0.95])
    p = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return found.groupBy(F.col("key").alias("command")).agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


@query(
    "metric_targets",
    f"""WITH {CALLS}, v AS (SELECT command AS metric, avg(duration_us) AS value FROM calls GROUP BY command), t(metric, relation, target) AS (VALUES ('view', '<', 50000.0::DOUBLE), ('click', '>=', 1.0::DOUBLE), ('purchase', '<=', 10.0::DOUBLE), ('absent', '>', 0.0::DOUBLE))
SELECT metric, relation, target, round(value, 6) AS value, coalesce(CASE relation WHEN '<' THEN value < target WHEN '<=' THEN value <= target WHEN '>' THEN value > target ELSE value >= target END, false) AS passed FROM t LEFT JOIN v USING (metric)""",
)
def metric_targets(spark, d):
    values = calls(spark, d).groupBy(F.col("command").alias("metric")).agg(F.avg("duration_us").alias("value"))
    targets = spark.createDataFrame([("view", "<", 50000.0), ("click", ">=", 1.0), ("purchase", "<=", 10.0), ("absent", ">", 0.0)], "metric string, relation string, target double")
    return M.against_targets(values, targets).withColumn("value", F.round("value", 6))


def runs(spark, d):
    """(run_id, arm, task, tokens, ok, command) from conversations."""
    command = F.array(*[F.lit(c) for c in COMMANDS])[(F.col("run_id") % len(COMMANDS)).cast("int")]
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("run_id")).agg(F.sum(F.length("text")).alias("tokens"), F.count("*").alias("turns"))
    return rows.select(
        "run_id", F.concat(F.lit("arm"), (F.col("run_id") % 3).cast("string")).alias("arm"), (F.col("run_id") % 10).alias("task"), "tokens", "turns",
        (F.col("run_id") % 4 != 0).alias("ok"), command.alias("command"),
    )


COMMANDS = ["led search x | head -3", "FOO=1 sudo cat a.txt && led read b", "grep -r foo . ; sed -n 1p f", "cat <<EOF > f\nled not this\nEOF\nls", "/usr/bin/led edit f || echo no"]
KINDS = [(1, 0, 1), (1, 1, 0), (0, 2, 0), (0, 1, 1), (1, 0, 1)]
FALLBACK, WRAPPERS = ["cat", "grep", "sed"], ["sudo", "time", "env", "nohup"]
RUNS = """runs AS (SELECT conv_id AS run_id, 'arm' || (conv_id % 3) AS arm, conv_id % 10 AS task, sum(length(text))::BIGINT AS tokens, count(*) AS turns, conv_id % 4 <> 0 AS ok FROM conversations GROUP BY conv_id)"""
KIND_ROWS = ", ".join(f"({i}, '{k}', {n})" for i, row in enumerate(KINDS) for k, n in zip(("tool", "fallback", "other"), row, strict=True) if n)


@query("classify_commands", f"WITH {RUNS} SELECT run_id, kind, n::BIGINT AS n FROM runs JOIN (VALUES {KIND_ROWS}) AS k(i, kind, n) ON run_id % {len(COMMANDS)} = i")
def classify_commands(spark, d):
    return M.classify_commands(runs(spark, d), "led", FALLBACK, WRAPPERS)


#: Price of a token, for the report's cost column.
PRICE = 3e-6


@query(
    "arm_summary",
    f"""WITH {RUNS}, k AS (SELECT run_id, sum(n) AS commands, coalesce(sum(n) FILTER (kind = 'tool'), 0) AS t, coalesce(sum(n) FILTER (kind = 'fallback'), 0) AS f
  FROM runs JOIN (VALUES {KIND_ROWS}) AS k(i, kind, n) ON run_id % {len(COMMANDS)} = i GROUP BY run_id)
SELECT arm, count(*) AS runs, count(*) FILTER (ok) AS successes, sum(tokens)::BIGINT AS tokens, sum(turns)::BIGINT AS turns, round(avg(tokens), 6) AS mean_tokens,
  sum(commands)::BIGINT AS commands, (count(*) - count(DISTINCT task))::BIGINT AS retries, sum(f)::DOUBLE / greatest(sum(t) + sum(f), 1)::DOUBLE AS fallback_rate,
  round(sum(tokens)::DOUBLE * {PRICE}, 6) AS cost FROM runs JOIN k USING (run_id) GROUP BY arm""",
)
def arm_summary(spark, d):
    """Runs of each arm; retries are the runs of a task behind its first."""
    kinds = classify_commands(spark, d)
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    by_run = kinds.groupBy("run_id").agg(F.sum("n").alias("commands"), n("tool").alias("t"), n("fallback").alias("f"))
    return runs(spark, d).join(by_run, "run_id").groupBy("arm").agg(
        F.count("*").alias("runs"), F.count_if("ok").alias("successes"), F.sum("tokens").alias("tokens"), F.sum("turns").alias("turns"), F.round(F.avg("tokens"), 6).alias("mean_tokens"),
        F.sum("commands").alias("commands"), (F.count("*") - F.countDistinct("task")).alias("retries"),
        (F.sum("f") / F.greatest(F.sum("t") + F.sum("f"), F.lit(1))).alias("fallback_rate"), F.round(F.sum("tokens").cast("double") * PRICE, 6).alias("cost"),
    )


@query("task_median", f"WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY task, arm ORDER BY tokens, run_id) - 1 AS i, count(*) OVER (PARTITION BY task, arm) AS n FROM runs) SELECT task, arm, run_id, tokens FROM r WHERE i = n // 2")
def task_median(spark, d):
    """The upper median run of each task and arm."""
    w = Window.partitionBy("task", "arm")
    rows = runs(spark, d).withColumn("i", F.row_number().over(w.orderBy("tokens", "run_id")) - 1).withColumn("n", F.count("*").over(w))
    return rows.where(F.col("i") == F.floor(F.col("n") / 2)).select("task", "arm", "run_id", "tokens")


@query(
    "fallback_rate",
    f"""WITH {RUNS}, k AS (SELECT arm, sum(n) FILTER (kind = 'tool') AS t, sum(n) FILTER (kind = 'fallback') AS f FROM runs JOIN (VALUES {KIND_ROWS}) AS k(i, kind, n) ON run_id % {len(COMMANDS)} = i GROUP BY arm)
SELECT arm, coalesce(f, 0)::DOUBLE / greatest(coalesce(t, 0) + coalesce(f, 0), 1)::DOUBLE AS rate FROM k""",
)
def fallback_rate(spark, d):
    kinds = classify_commands(spark, d).join(runs(spark, d).select("run_id", "arm"), "run_id")
    n = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0))
    return kinds.groupBy("arm").agg((n("fallback") / F.greatest(n("tool") + n("fallback"), F.lit(1))).alias("rate"))


@query(
    "debounce_batches",
    """WITH RECURSIVE e AS (SELECT user_id % 50 AS stream, ts, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts) AS i FROM events),
f AS (SELECT stream, i, ts AS first_ts, ts AS last_ts, 1 AS batch FROM e WHERE i = 1
  UNION ALL SELECT e.stream, e.i, CASE WHEN e.ts - f.last_ts <= INTERVAL 600 SECOND AND e.ts - f.first_ts <= INTERVAL 1800 SECOND THEN f.first_ts ELSE e.ts END, e.ts,
    f.batch + CASE WHEN e.ts - f.last_ts <= INTERVAL 600 SECOND AND e.ts - f.first_ts <= INTERVAL 1800 SECOND THEN 0 ELSE 1 END
  FROM f JOIN e ON e.stream = f.stream AND e.i = f.i + 1)
SELECT stream, min(first_ts) AS first_ts, max(last_ts) AS last_ts, count(*)::INT AS n FROM f GROUP BY stream, batch""",
)
def debounce_batches(spark, d):
    return M.debounce(table(spark, d, "events").select((F.col("user_id") % 50).alias("stream"), "ts"), 600_000, 1_800_000)


@query("json_sink", f"WITH {CALLS} SELECT call_id, '{{\"v\":1,\"ok\":' || (CASE WHEN outcome = 'ok' THEN 'true' ELSE 'false' END) || ',\"outcome\":\"' || outcome || '\",\"data\":{{\"command\":\"' || command || '\",\"us\":' || duration_us || '}}}}' AS line FROM calls")
def json_sink(spark, d):
    """Versioned JSON lines of results, written as text and read back."""
    row = F.struct(F.lit(1).alias("v"), (F.col("outcome") == "ok").alias("ok"), "outcome", F.struct("command", F.col("duration_us").alias("us")).alias("data"))
    at = work_path(spark, "results")
    calls(spark, d).select(F.to_json(F.struct("call_id", F.to_json(row).alias("line"))).alias("value")).write.text(at)
    return spark.read.schema("call_id long, line string").json(at)


EVENT = "type string, id string, name string, tool_use_id string, text string, usage struct<input:bigint,output:bigint>"


def transcript(spark, d):
    """A JSON-lines event stream of the conversations, written as text and read with a fixed schema."""
    user = F.struct(F.lit("result").alias("type"), F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("tool_use_id"), "text")
    call = F.struct(F.lit("call").alias("type"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("led").alias("name"), F.struct(F.length("text").alias("input"), F.lit(1).alias("output")).alias("usage"))
    lines = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, F.to_json(call)).otherwise(F.to_json(user)).alias("line"))
    return lines.select("conv_id", F.from_json("line", EVENT).alias("e")).select("conv_id", "e.*")


@query(
    "transcript_source",
    "SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS calls, count(*) FILTER (turn % 2 <> 0) AS results, coalesce(sum(length(text)) FILTER (turn % 2 = 0), 0)::BIGINT AS input_tokens FROM conversations GROUP BY conv_id",
)
def transcript_source(spark, d):
    return transcript(spark, d).groupBy("conv_id").agg(
        F.count_if(F.col("type") == "call").alias("calls"), F.count_if(F.col("type") == "result").alias("results"), F.coalesce(F.sum("usage.input"), F.lit(0)).alias("input_tokens")
    )


@query(
    "tool_result_match",
    "SELECT c.conv_id, count(*) AS matched, count(*) FILTER (contains(lower(r.text), 'the')) AS retries FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 WHERE c.turn % 2 = 0 GROUP BY c.conv_id",
)
def tool_result_match(spark, d):
    events = transcript(spark, d)
    results = events.where("type = 'result'").select(F.col("tool_use_id").alias("id"), F.col("text").alias("answer"))
    return events.where("type = 'call'").join(results, "id").groupBy("conv_id").agg(F.count("*").alias("matched"), F.count_if(F.lower("answer").contains("the")).alias("retries"))
