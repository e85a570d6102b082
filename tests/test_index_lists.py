"""Indexes made in batches, and searches whose tasks don't hold all hits of a query."""

import random

import pytest
from pyspark.sql import functions as F

from textledger.functions import text as T
from textledger.operators import search as S

LETTERS = "aAbBİi̇ΣσςßẞÄä漢09²½Ⅷ٣_-' \r\t\0KǅⅠ"


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[None, 40])
def small(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(S, "PIECE", request.param)
        monkeypatch.setattr(S, "WORDS_PIECE", request.param)


def test_trigrams_of_batches(spark, small):
    random.seed(1)
    texts = [["".join(random.choices(LETTERS + "𐐀𐐨", k=random.choice([0, 1, 2, 3, 5, 30]))) for _ in range(random.choice([0, 1, 2, 9]))] for _ in range(200)]
    chunks = spark.createDataFrame([(f"p{i}", i % 3, lines) for i, lines in enumerate(texts)], "path string, chunk_no int, lines array<string>")
    one_by_one = rows(chunks.select(F.explode(F.array_distinct(F.flatten(F.transform("lines", T.trigrams)))).alias("tri"), "path", "chunk_no"))
    assert rows(S.trigram_index(chunks)) == one_by_one
    assert rows(S.trigram_lists(chunks).select("tri", F.inline("spots"))) == one_by_one
    assert "MapInArrow" in plan(S.trigram_index(chunks))


def test_trigrams_are_of_characters(spark):
    """A character of two UTF-16 units is one."""
    assert spark.range(1).select(T.trigrams(F.lit("a𐐨bc"))).first()[0] == ["a𐐨b", "𐐨bc"]


def test_words_of_batches(spark, small):
    random.seed(2)
    texts = ["".join(random.choices(LETTERS if i % 3 else "aBc 9-", k=random.choice([0, 1, 2, 5, 30, 80]))) for i in range(200)]
    files = spark.createDataFrame([(f"p{i % 190}", t) for i, t in enumerate(texts)] + [("n", None)], "path string, content string")
    expected = rows(files.select("path", F.explode(T.words_text(F.col("content"))).alias("token")).groupBy("token", "path").agg(F.count("*").alias("tf")))
    assert rows(S.word_index(files)) == expected
    assert rows(S.word_lists(files).select("token", F.inline("spots")).select("token", "path", "tf")) == expected
    once = files.dropDuplicates(["path"]).localCheckpoint()
    assert "hashpartitioning(token" not in plan(S.word_index(once))


def test_hits_are_not_shuffled_by_query(spark):
    queries = spark.createDataFrame([(1, "abc"), (2, "bcd")], "query_id long, text string")
    chunks = spark.createDataFrame([(f"p{i}", 0, ["xabcx", "bcd", "-"]) for i in range(20)], "path string, chunk_no int, lines array<string>")
    found = S.spots(S.candidates(S.literal_needles(queries), S.trigram_index(chunks))).localCheckpoint()
    hits = S.verified(found, chunks, queries, S.literal_match())
    assert hits.count() == 40 and "hashpartitioning(query_id" not in plan(hits)


def test_words_of_a_line_are_taken_once(spark):
    lines = spark.createDataFrame([("p", 1, "the MitLicense"), ("p", 2, "mit"), ("p", 3, "of licenses")], "path string, line_no int, text string")
    terms = spark.createDataFrame([(1, "license MIT"), (2, "MitLicense the")], "query_id long, text string").select("query_id", T.query_terms(F.col("text")).alias("terms"))
    scores = S.worded_lines(lines).crossJoin(F.broadcast(terms)).select("query_id", "line_no", T.words_score(F.col("plain"), F.col("words"), F.col("terms")).alias("n"))
    one_by_one = lines.crossJoin(terms).select("query_id", "line_no", T.line_score(F.col("text"), F.col("terms")).alias("n"))
    assert rows(scores) == rows(one_by_one)


def test_replaced_keeps_what_did_not_change(spark, monkeypatch):
    index = spark.createDataFrame([("a", f"p{i}", i % 2) for i in range(50)], "tri string, path string, chunk_no int")
    fresh = spark.createDataFrame([("b", "p1", 1)], index.schema)
    changed = index.where("path in ('p1', 'p4')").select("path", "chunk_no")
    expected = sorted([("a", f"p{i}", i % 2) for i in range(50) if i not in (1, 4)] + [("b", "p1", 1)])
    assert rows(S.replaced(index, fresh, changed).select(*index.columns)) == expected
    monkeypatch.setattr(S, "MOST_CHANGED", 1)
    assert rows(S.replaced(index, fresh, changed).select(*index.columns)) == expected
