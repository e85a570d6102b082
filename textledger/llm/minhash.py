"""MinHash near-duplicates with tensored banding, and their connected components.

A document is its set of distinct word shingles. Two small collections of half keys are made, M keys
of two minhashes each; a table's key joins one of either, so 4 M minhashes serve M * M tables of four.
Documents of similarity s share a table unless one collection matches nowhere: with M = 8 that is
1 - (1 - (1 - s^2)^8)^2, 0.06 % at 0.8 and 0.007 % at 0.85.

Equal sets are one class before any table is built, so exact copies cost one row each. In a table's
bucket no pairs are written out. In rounds, first one representative of each bucket and then up to 64, one of each of as
many hash parts, are compared with the members of other components; every comparison uses the full
sets. Representatives are those with the most rows in all their buckets, so the text that a group's
copies come from is the first; keys that hold more than 1 / HOT of the rows are dealt over several tasks. Ids are whole numbers. Verified links join components (alternating large and small stars, on tables in the shared
folder); representatives leave their buckets, their pairs being decided, and buckets of one component
are done. A bucket of one large group of near copies so needs about one comparison for each member.
What is left after the first round of buckets with more than LARGE members, texts just below the
threshold, is packed in blocks of MEMBERS sets, and blocks that hold different components are
compared as matrices: rows are blocks, not pairs, and only links that join components come out.

Defined results: null texts and texts without words have the empty set and link with nothing; fewer
words than a shingle are one shingle, the whole sequence; rows with equal sets are one class whatever
their ids; rows that share an id and differ in text are one node with several sets, linked through
any of them; rows without an id take the component of an equal row that has one, else they have none
and are kept; an empty table gives no rows; other columns are ignored. Shingles are compared as
64-bit hashes, sets for equality by a 128-bit digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT, all_salts, dealt, delete, salt_of, shared_path, table, tidy, written

HALF_KEYS = 8
ROWS = 2
_rng = np.random.RandomState(20240229)
FACTORS = _rng.randint(0, 1 << 63, 2 * HALF_KEYS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _rng.randint(0, 1 << 63, 2 * HALF_KEYS * ROWS, dtype=np.int64).astype(np.uint64)
BLOCK = 1 << 14
#: Buckets with more members are compared block against block; members in a block.
LARGE = 64
MEMBERS = 256


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingles. bytes.lower() changes A-Z only; bytes.split() splits at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = scatter(out + h[k : k + n] + np.uint64(k))
    return np.unique(out)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    low = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        part = (shingles[None, at : at + BLOCK] ^ MASKS[:, None]) * FACTORS[:, None]
        low = np.minimum(low, (part ^ (part >> np.uint64(29))).min(axis=1))
    return low


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """2 * HALF_KEYS numbers, the first half for one collection, the rest for the other."""
    m = scatter(minhashes(shingles)).reshape(-1, ROWS)
    out = np.zeros(len(m), np.uint64)
    for k in range(ROWS):
        out = scatter(out + m[:, k])
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, cls, a, b): the set's size and digest and the two collections of half keys."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, cls, a, b = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width, known)
                n.append(len(s))
                keys = half_keys(s) if len(s) else None
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                a.append(None if keys is None else keys[:HALF_KEYS])
                b.append(None if keys is None else keys[HALF_KEYS:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(a, longs), pa.array(b, longs)],
                ["id", "n_shingles", "cls", "a", "b"],
            )

    return rows.mapInArrow(run, f"id {id_type}, n_shingles long, cls binary, a array<long>, b array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, node, size, weight) for every pair of half keys, where more than one node has the key.

    weight: the rows of all the node's buckets. It is largest for the text that a group was copied from.
    """
    pairs = F.flatten(
        F.transform("a", lambda x, i: F.transform("b", lambda y, j: F.xxhash64(x, y, i * HALF_KEYS + j)))
    )
    keys = classes.select(F.posexplode(pairs).alias("slot", "key"), "node", "size")
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    rows = written(keys.join(shared.select("key", "n").hint("merge"), "key"), "shared-keys")
    weights = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    out = written(rows.join(weights.hint("merge"), "node").select("key", "slot", "node", "size", "weight"), "buckets")
    delete(rows)
    return out


def sets_of(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))
    rows = rows.join(nodes.hint("shuffle_hash"), "node", "left_semi")
    id_type = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.mapInArrow(run, f"node {id_type}, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("su"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv"))
    id_type = pairs.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("su"), batch.column("sv"), strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # The text that a large group was copied from is in most of its pairs.
    some, every = dealt(pairs.join(right.hint("merge"), "v"), left, "u", "v", pairs)
    both = some.join(every.hint("merge"), ["u", "_salt"]).select("u", "v", "su", "sv")
    return both.mapInArrow(run, f"u {id_type}, v {id_type}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of the edges (u, v): comp is the least node that it reaches."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: every larger neighbour of a node links to the node's least neighbour.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours link to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        delete(edges)
        edges = after
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
        ends = ends.union(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        if ends.where("out > 1 or out = 1 and `in` = 1").isEmpty():
            # Every edge leads from a node with no other to a centre, so these are stars around least nodes, each its own component.
            centres = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(centres)


BLOCK_SCHEMA = "key long, slot int, block long, low long, high long, rows binary, shingles binary"
ROW = np.dtype([("node", np.int64), ("comp", np.int64), ("a", np.int64, HALF_KEYS), ("b", np.int64, HALF_KEYS), ("n", np.int64)])


def pack_blocks(members: DataFrame) -> DataFrame:
    """members (key, slot, comp, node, a, b, shingles) of large buckets, in blocks of up to MEMBERS rows.

    They are range-sorted by key and component, so a large bucket is spread over tasks and its blocks
    mostly hold one component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, held = TaskContext.get().partitionId() << 32, []

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            rows = np.array([h[2] for h in held], ROW)
            out = {
                "key": held[0][0], "slot": held[0][1], "block": seq, "low": int(rows["comp"].min()), "high": int(rows["comp"].max()),
                "rows": rows.tobytes(), "shingles": b"".join(h[3] for h in held),
            }
            seq, held = seq + 1, []
            schema = [("key", pa.int64()), ("slot", pa.int32()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("rows", pa.binary()), ("shingles", pa.binary())]
            return pa.RecordBatch.from_pylist([out], schema=pa.schema(schema))

        for batch in batches:
            for key, slot, comp, node, a, b, shingles in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (held[0][0] != key or len(held) == MEMBERS):
                    yield flush()
                held.append((key, slot, (node, comp, a, b, len(shingles) // 8), shingles))
        if held:
            yield flush()

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = members.repartitionByRange(n, "key", "comp", "node").sortWithinPartitions("key", "comp", "node")
    return ranged.mapInArrow(run, BLOCK_SCHEMA)


def intersections(p: np.ndarray, p_of: np.ndarray, n: int, q: np.ndarray, q_of: np.ndarray, m: int) -> np.ndarray:
    """How many shingles each of n sets shares with each of m; p_of and q_of tell the shingles' sets."""
    common = np.intersect1d(p, q)
    out = np.zeros((n, m), np.float32)
    keep_p, keep_q = np.isin(p, common), np.isin(q, common)
    at_p, at_q = np.searchsorted(common, p[keep_p]), np.searchsorted(common, q[keep_q])
    p_of, q_of = p_of[keep_p], q_of[keep_q]
    for low in range(0, len(common), 4096):
        x, y = np.zeros((n, 4096), np.float32), np.zeros((m, 4096), np.float32)
        u, v = (at_p >= low) & (at_p < low + 4096), (at_q >= low) & (at_q < low + 4096)
        x[p_of[u], at_p[u] - low] = 1
        y[q_of[v], at_q[v] - low] = 1
        out += x @ y.T
    return out


def linked_pairs(r: dict, percent: int) -> list[tuple[int, int]]:
    """Links between the members of two blocks of a bucket that join different components, no more than join them.

    A pair that shares several buckets is compared in the one with the least slot.
    """
    x, y = np.frombuffer(r["rows"], ROW), np.frombuffer(r["other_rows"], ROW)
    first_a = np.full((len(x), len(y)), HALF_KEYS)
    first_b = first_a.copy()
    for k in range(HALF_KEYS - 1, -1, -1):
        first_a[x["a"][:, k][:, None] == y["a"][:, k][None]] = k
        first_b[x["b"][:, k][:, None] == y["b"][:, k][None]] = k
    small, large = np.minimum(x["n"][:, None], y["n"][None]), np.maximum(x["n"][:, None], y["n"][None])
    asked = (first_a * HALF_KEYS + first_b == r["slot"]) & (x["comp"][:, None] != y["comp"][None]) & (100 * small >= percent * large)
    rows, cols = asked.any(axis=1).nonzero()[0], asked.any(axis=0).nonzero()[0]
    if not len(rows):
        return []

    def part(z: np.ndarray, raw: bytes, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, end = np.frombuffer(raw, np.uint64), np.cumsum(z["n"])
        sets = [s[end[k] - z["n"][k] : end[k]] for k in keep]
        return np.concatenate(sets), np.repeat(np.arange(len(keep)), z["n"][keep])

    both = intersections(*part(x, r["shingles"], rows), len(rows), *part(y, r["other_shingles"], cols), len(cols))
    total = x["n"][rows][:, None] + y["n"][cols][None] - both
    ok = asked[np.ix_(rows, cols)] & (100 * both >= percent * total)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        u, v = root(int(x["comp"][rows[i]])), root(int(y["comp"][cols[j]]))
        if u != v:
            parent[u] = v
            out.append((int(x["node"][rows[i]]), int(y["node"][cols[j]])))
    return out


def block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the members (see pack_blocks) of large buckets, block against block."""
    blocks = written(pack_blocks(members), "blocks")
    spots = blocks.select("key", "block", "low", "high")
    one = F.col("l.low").eqNullSafe(F.col("l.high")) & (F.col("r.low") == F.col("r.high")) & (F.col("l.low") == F.col("r.low"))
    pairs = spots.alias("l").join(spots.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.block") <= F.col("r.block")) & ~one)
    pairs = pairs.select(F.col("l.block").alias("block"), F.col("r.block").alias("other"))
    other = blocks.select(F.col("block").alias("other"), F.col("rows").alias("other_rows"), F.col("shingles").alias("other_shingles"))
    work = pairs.join(blocks.select("block", "slot", "rows", "shingles"), "block").join(other, "other").select("slot", "rows", "shingles", "other_rows", "other_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = linked_pairs(batch.slice(i, 1).to_pylist()[0], percent)
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return work.mapInArrow(run, "u long, v long").distinct()


def link_components(buckets: DataFrame, sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Components of the nodes in the buckets (key, slot, node, size, weight) under verified links, in rounds."""
    session = buckets.sparkSession
    comps = session.createDataFrame([], "node long, comp long")
    tested = shared_path(session, "tested")  # a folder of pairs for each round
    step, old, turn = 0, None, 0

    def joined(links: DataFrame, before: DataFrame) -> DataFrame:
        after = written(components(links.union(before.select("node", "comp"))), "components")
        delete(before)
        tidy(session)
        return after

    while True:
        named = buckets.join(comps.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_ = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).where("low < high")
        live = written(named.join(open_.select("key", "n").hint("merge"), "key").select("key", "slot", "node", "size", "weight", "comp", "n"), "buckets")
        if old is not None:
            delete(old)
        old = live
        if live.isEmpty():
            delete(live)
            delete(tested, session)
            return comps
        large = live.where(F.col("n") > LARGE)
        if step == 1:
            step = 3  # what isn't large is small enough for 4^3 representatives at once
        if step == 3 and not large.isEmpty():
            members = large.join(sets.hint("merge"), "node").join(classes.select("node", "a", "b").hint("merge"), "node")
            members = members.select("key", "slot", "comp", "node", "a", "b", "shingles")
            links = written(block_links(members, percent), "block-links")
            buckets = live.where(F.col("n") <= LARGE).drop("comp", "n")
            comps = joined(links, comps)
            delete(links)
            continue
        hot = F.col("n") * HOT > live.count()
        part = F.pmod(F.xxhash64("node"), F.lit(4**step))
        reps = live.groupBy("key", part.alias("part")).agg(F.max_by(F.struct("node", "comp", "size"), F.struct("weight", -F.col("node"))).alias("r"), F.first("n").alias("n"))
        reps = reps.withColumn("salt", all_salts(hot))
        reps = reps.select("key", "salt", F.col("r.node").alias("rep"), F.col("r.comp").alias("rep_comp"), F.col("r.size").alias("rep_size"))
        near = 100 * F.least("size", "rep_size") >= percent * F.greatest("size", "rep_size")  # else they can't be linked
        salted = live.withColumn("salt", salt_of("node", hot))
        same = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt"))
        pairs = salted.alias("l").join(reps.alias("r").hint("merge"), same & (F.col("comp") != F.col("rep_comp")) & near)
        pairs = pairs.select(F.least("node", "rep").alias("u"), F.greatest("node", "rep").alias("v")).distinct()
        if turn:
            pairs = pairs.join(session.read.schema("u long, v long").parquet(*[f"{tested}/{k}" for k in range(turn)]).hint("merge"), ["u", "v"], "left_anti")
        pairs.write.parquet(f"{tested}/{turn}")
        links = verified(session.read.schema("u long, v long").parquet(f"{tested}/{turn}"), sets, percent)
        comps = joined(links, comps)
        turn += 1
        gone = reps.where("salt = 0").select("key", F.col("rep").alias("node"))
        buckets, step = live.drop("comp", "n").join(gone.hint("merge"), ["key", "node"], "left_anti"), step + 1


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    sigs = written(signatures(docs, id_col, text_col, width), "signatures")
    classes = sigs.where("cls is not null").groupBy("cls").agg(
        F.min("id").alias("node"), F.first("n_shingles").alias("size"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    classes = written(classes, "classes")
    buckets = table_keys(classes.where("node is not null"))
    sets = written(sets_of(docs, buckets.select("node").distinct(), id_col, text_col, width), "sets")
    comps = link_components(buckets, sets, classes, percent)
    delete(buckets)
    delete(sets)
    named = classes.select("cls", "node").join(comps, "node", "left").select("cls", F.coalesce("comp", "node").alias("component"))
    component = F.coalesce("component", "id")
    return sigs.join(named, "cls", "left").select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""
