"""Ranked lexical search of many queries at once, which share what their terms have in common.

Terms of all queries are put in a block's vocabulary. A first pass over the documents writes, for each
document, its number of terms and the (term, count) of those in the vocabulary; counts over that table
give the statistics. A second pass over it scores: what a term adds to a document is worked out once.

Queries with the same terms are one query. Within a block, terms that stand in the same queries are one
leaf of a directed acyclic graph. Each query is then its list of leaves, by falling number of queries,
and neighbours that stand together in several lists are joined to a new node, over and over, until no
pair is left in two lists: the shared term sets. For a batch of documents, a leaf's accumulator is the sum of
its terms' parts and a node's the sum of its two nodes' accumulators, each worked out once; a query adds up
what is left of its list. A term that a query repeats counts as further terms, one for each repeat.

Each task keeps the best `top` rows of each query, and the tasks' rows meet in one table, so what moves is
tasks x queries x top rows. Queries are taken in blocks of about `block_bytes` of their distinct terms, close
ones (by the least hash of their terms) together; each block's vocabulary and graph are broadcast, and a
block makes two passes. A single query's distinct terms, and what a task holds of it, aren't split.

Defined results: null texts and texts without a term match nothing and aren't counted; document and item ids
may be null or repeat, each row is a document or a query of its own; equal scores are listed by ascending
document id, rows without id last; an item without terms, empty documents or an empty benchmark give no rows;
other columns are ignored. Texts are read whole, in pieces of `PIECE` bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.history import cumulative
from .common import delete, table, written
from .fm_index import FOLD

TOP = 10
BLOCK_BYTES = 4 << 20
PIECE = 1 << 20
#: Cells of a task's matrix of accumulators.
CELLS = 1 << 23
LEAF, NODE, QUERY = 0, 1, 2
GRAPH = "block long, kind int, node long, a long, b long, term string"


def counted(text: str | None) -> Counter[bytes]:
    """The text's terms with their counts: maximal runs of ASCII letters (lower-cased), digits and other characters."""
    out: Counter[bytes] = Counter()
    folded = text.encode().translate(FOLD) if text else b""
    start = 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        out.update(folded[start:end].split())
        start = end
    return out


def queries_of(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, low, size, terms, repeats) of each item with terms."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = sorted(counted(b.column(1)[i].as_py()).items())
                if found:
                    digest = hashlib.sha256(b"\n".join(b"%b %d" % x for x in found)).hexdigest()
                    low = min(zlib.crc32(t) for t, _ in found)
                    terms, repeats = zip(*found, strict=True)
                    size = sum(map(len, terms)) + 16 * len(terms)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0)[i : i + 1], pa.array([digest]), pa.array([low]), pa.array([size]), pa.array([[t.decode() for t in terms]]), pa.array([list(repeats)])],
                        ["id", "digest", "low", "size", "terms", "repeats"],
                    )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, digest string, low long, size long, terms array<string>, repeats array<long>")


def shared_terms(lists: list[list[int]], top: int) -> list[tuple[int, int, int]]:
    """Joins neighbours that stand in two lists or more to new nodes (node, left, right), numbered from top; the lists are changed in place.

    Each list is in one common order, so equal sets of nodes tend to be neighbours. The time of a round is
    linear in the lists, and each round shortens some.
    """
    made: list[tuple[int, int, int]] = []
    while True:
        pairs = Counter(p for x in lists for p in zip(x, x[1:], strict=False))
        named: dict[tuple[int, int], int] = {}
        for k, x in enumerate(lists):
            out, i = [], 0
            while i < len(x):
                pair = tuple(x[i : i + 2])
                after = tuple(x[i + 1 : i + 3])
                if len(pair) == 2 and pairs[pair] > 1 and (len(after) < 2 or pairs[pair] >= pairs[after]):
                    if pair not in named:
                        named[pair] = top + len(named)
                    out.append(named[pair])
                    i += 2
                else:
                    out.append(x[i])
                    i += 1
            lists[k] = out
        if not named:
            return made
        made += [(node, *pair) for pair, node in named.items()]
        top += len(named)


def graph(block: int, queries: list[int], terms: list[list[str]], repeats: list[list[int]]) -> pd.DataFrame:
    """The block's graph as rows: (term, leaf), (node, its two nodes), (query, a node of its list)."""
    holders: dict[tuple[str, int], list[int]] = {}
    for k, (names, counts) in enumerate(zip(terms, repeats, strict=True)):
        for t, n in zip(names, counts, strict=True):
            for layer in range(n):
                holders.setdefault((t, layer), []).append(k)
    leaves: dict[tuple[int, ...], int] = {}
    rows = []
    for (t, _), who in sorted(holders.items(), key=lambda x: (-len(x[1]), x[0])):
        leaf = leaves.setdefault(tuple(who), len(leaves))  # common ones get small numbers
        rows.append((block, LEAF, leaf, None, None, t))
    lists: list[list[int]] = [[] for _ in queries]
    for who, leaf in leaves.items():
        for k in who:
            lists[k].append(leaf)
    rows += [(block, NODE, node, left, right, None) for node, left, right in shared_terms(lists, len(leaves))]
    rows += [(block, QUERY, node, queries[k], None, None) for k, x in enumerate(lists) for node in x]
    return pd.DataFrame(rows, columns=["block", "kind", "node", "a", "b", "term"]).astype({"a": "Int64", "b": "Int64"})


def graphs(queries: DataFrame) -> DataFrame:
    """The graph of each block of queries (query, block, terms, repeats)."""

    def mine(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("query")
        return graph(int(rows["block"].iloc[0]), rows["query"].tolist(), [list(x) for x in rows["terms"]], [list(x) for x in rows["repeats"]])

    return queries.select("query", "block", "terms", "repeats").groupBy("block").applyInPandas(mine, GRAPH)


def postings(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts) of each document with a term: all its terms' number, and the vocabulary's among them by number."""
    session = docs.sparkSession
    shared = session.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, n, sizes, terms, counts = [], [], [0], [], []
            for i in range(b.num_rows):
                found = counted(b.column(1)[i].as_py())
                if found:
                    ids.append(i)
                    n.append(found.total())
                    for t in found.keys() & known.keys():
                        terms.append(known[t])
                        counts.append(found[t])
                    sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))],
                ["id", "n", "terms", "counts"],
            )

    return rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


class Plan:
    """A block's graph as arrays, for tasks."""

    def __init__(self, rows: list, weights: np.ndarray, number: dict[str, int], n_docs: int, n_terms: int) -> None:
        self.weights, self.n_docs, self.n_terms = weights, n_docs, n_terms
        of_leaf = sorted((number[r.term], r.node) for r in rows if r.kind == LEAF)
        self.leaf = np.array([x[1] for x in of_leaf], np.int64)
        self.first = np.searchsorted(np.array([x[0] for x in of_leaf], np.int64), np.arange(len(weights) + 1))
        self.leaves = int(self.leaf.max(initial=-1)) + 1
        self.nodes = sorted((r.node, r.a, r.b) for r in rows if r.kind == NODE)
        lists: dict[int, list[int]] = {}
        for r in rows:
            if r.kind == QUERY:
                lists.setdefault(r.a, []).append(r.node)
        self.queries = np.array(sorted(lists), np.int64)
        self.lists = [lists[q] for q in self.queries.tolist()]

    def scores(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Scores by (query, document) of documents with n terms; owner: each posting's document."""
        m = 25 + 75 * n * self.n_docs // self.n_terms
        part = self.weights[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m[owner]))
        layers = self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), layers)
        layer = np.arange(len(which)) - np.repeat(np.cumsum(layers) - layers, layers)
        sums = np.zeros((self.leaves + len(self.nodes), len(n)), np.int64)
        np.add.at(sums.reshape(-1), self.leaf[self.first[terms[which]] + layer] * len(n) + owner[which], part[which])
        for node, left, right in self.nodes:
            np.add(sums[left], sums[right], out=sums[node])
        return np.stack([sums[x].sum(axis=0) if len(x) > 1 else sums[x[0]] for x in self.lists])


def best(rows: np.ndarray, top: int) -> np.ndarray:
    """The first `top` rows of each query of (query, score, no id, id, ...) columns, by score, then id."""
    rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
    nth = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
    return rows[:, nth < top]


def top_rows(found: DataFrame, plan, top: int) -> DataFrame:
    """(query, score, id): each task's best rows of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        held = np.zeros((4, 0), np.int64)
        least = np.ones(len(p.queries), np.int64)
        size = max(1, CELLS // max(1, p.leaves + len(p.nodes) + len(p.queries)))
        for b in batches:
            ids, none = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column(1).to_numpy()
            ends = np.cumsum(b.column(2).value_lengths().to_numpy())
            terms, counts = b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()
            for start in range(0, len(n), size):
                end = min(start + size, len(n))
                bounds = np.concatenate(([ends[start - 1] if start else 0], ends[start:end]))
                owner = np.repeat(np.arange(end - start), np.diff(bounds))
                cut = slice(bounds[0], bounds[-1])
                scores = p.scores(n[start:end], owner, terms[cut], counts[cut])
                q, d = np.nonzero(scores >= least[:, None])
                fresh = np.stack((q, scores[q, d], none[start + d], ids[start + d]))
                held = best(np.concatenate((held, fresh), axis=1), top)
                many = np.bincount(held[0], minlength=len(least))
                last = np.cumsum(many) - 1
                least = np.where(many == top, held[1][last] if len(held[1]) else 1, 1)
        if held.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(p.queries[held[0]]), pa.array(held[1]), pa.array(held[3], mask=held[2] == 1)], ["query", "score", "id"])

    return found.mapInArrow(run, "query long, score long, id long")


def block_search(docs: DataFrame, rows: list, top: int, id_col: str, text_col: str) -> DataFrame | None:
    """The best rows of a block's queries; rows: the block's graph."""
    spark = docs.sparkSession
    vocabulary = sorted({r.term for r in rows if r.kind == LEAF})
    found = written(postings(docs, vocabulary, id_col, text_col), "ranked-postings")
    total = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        delete(found)
        return None
    # a row for each term of the vocabulary at most
    df = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * total.docs + 2).cast("double") / (2 * F.col("df") + 1))))
    weights = np.zeros(len(vocabulary), np.int64)
    for r in df.select("term", weight.alias("w")).collect():
        weights[r.term] = r.w
    number = {t: i for i, t in enumerate(vocabulary)}
    plan = spark.sparkContext.broadcast(Plan(rows, weights, number, total.docs, total.terms))
    out = written(top_rows(found, plan, top), "ranked-rows")
    plan.unpersist()
    delete(found)
    return out


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of each row of items."""
    spark = docs.sparkSession
    kept = written(queries_of(items, item_id, item_text), "ranked-items")
    same = kept.groupBy("digest").agg(F.first(F.struct("low", "size", "terms", "repeats")).alias("x"))
    same = written(same.select("digest", "x.*").withColumn("query", F.monotonically_increasing_id()), "ranked-queries")
    placed = cumulative(same, "low", "size").withColumn("block", F.floor(F.col("before") / block_bytes))
    placed = written(placed.select("query", "digest", "block", "terms", "repeats"), "ranked-blocks")
    delete(same)
    nodes = written(graphs(placed), "ranked-graph")
    schema = "query long, score long, id long"
    parts = []
    for b in [r.block for r in placed.select("block").distinct().orderBy("block").collect()]:  # numbers of blocks
        out = block_search(docs, nodes.where(F.col("block") == b).collect(), top, doc_id, text_col)
        if out is not None:
            parts.append(out)
    rows = spark.createDataFrame([], schema)
    for p in parts:
        rows = rows.unionByName(p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = kept.select(F.col("id").alias(item_id), "digest").join(placed.select("query", "digest"), "digest")
    out = written(named.join(rows, "query").select(item_id, "rank", F.col("id").alias(doc_id), "score"), "ranked")
    for t in (kept, placed, nodes, *parts):
        delete(t)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT rid, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
stats AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nl FROM docs),
tf AS (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM docs) GROUP BY rid, t),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
wt AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS wt FROM df, stats),
i AS (SELECT row_number() OVER () AS irow, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT irow, t, count(*)::BIGINT AS c FROM (SELECT irow, unnest(w) AS t FROM i) GROUP BY irow, t),
p AS (SELECT tf.rid, tf.t, wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nl))) AS s
  FROM tf JOIN docs USING (rid) JOIN wt USING (t) CROSS JOIN stats WHERE tf.t IN (SELECT t FROM q)),
s AS (SELECT irow, rid, sum(c * s)::BIGINT AS score FROM q JOIN p USING (t) GROUP BY irow, rid),
r AS (SELECT irow, doc_id, score, row_number() OVER (PARTITION BY irow ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r JOIN i USING (irow) WHERE rank <= 10"""
