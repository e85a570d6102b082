"""Indexed search against a scan: Java patterns, and letters whose lower case depends on their neighbours."""

import random

import pytest
from pyspark.errors import IllegalArgumentException
from pyspark.sql import functions as F

from textledger.functions import literals
from textledger.operators import search as S
from textledger.operators import stored_search
from textledger.sources.tables import work_path

LETTERS = "abcxyzΑΣΟΔσςİıẞßſKÅé-]&^"
PARTS = [
    "abc", "xyz", "ΟΔΟΣ", "a", "İx", ".", "[abc]", "[^abc]", "[a-z&&[^b]]", "[a[xy]]", "[\\]a]", "[&&x]", "\\p{L}", "\\pL", "\\Qa.b]\\E", "\\h", "\\w", "\\bxyz", "(?:abc|xyz)", "(abc|x)", "(?<n>abc)",
    "(?=abc)abc", "(?<!x)abc", "\\x61bc", "\\u0061bc", "\\x{3A3}", "(?>xyz)", "[a-c]xyz", "[\\w&&x]", "\\.", "\\]", "(?i)ABC", "(?i:XYZ)", "(?s)xyz", "[\\Qab\\E]xyz",
]


def patterns(rng, n):
    for _ in range(n):
        out = ""
        for _ in range(rng.randrange(1, 5)):
            out += rng.choice(PARTS) + rng.choice(["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"])
            out += rng.choice(["", "", "", "|"])
        yield out


def test_java_patterns_need_what_they_say(spark):
    """Wherever the pattern matches a line, some clause's strings all stand in it."""
    rng = random.Random(7)
    valid = []
    for p in set(patterns(rng, 600)):
        try:
            spark._jvm.java.util.regex.Pattern.compile(p)
            valid.append(p)
        except IllegalArgumentException:  # such as a group's name twice
            pass
    asked = sorted({*valid} | {"[a-z&&[^b]]xyz", "\\p{L}+foo", "\\Qa.b\\E", "\\hfoo"})
    texts = ["".join(rng.choice([rng.choice(LETTERS), "abc", "xyz", "a.b]", "ΟΔΟΣ", " foo", "ABC"]) for _ in range(rng.randrange(1, 12))) for _ in range(120)]
    rows = spark.createDataFrame([(p,) for p in asked], "pattern string").crossJoin(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = rows.where(F.expr("text rlike pattern")).collect()
    useful = set()
    for r in found:
        need = literals.required(r.pattern)
        if need is not None:
            useful.add(r.pattern)
            assert any(all(w in r.text for w in clause) for clause in need), (r.pattern, r.text, need)
    assert len(useful) > 50
    assert literals.required("[a-z&&[^b]]xyz") == [frozenset({"xyz"})] and literals.required("\\p{L}+foo") == [frozenset({"foo"})]
    assert literals.required("\\Qa.b\\E") == [frozenset({"a.b"})] and literals.required("(?i)abc") is None
    for odd in ("[]a]", "a**", "(", "a)", "\\y", "x{a}", "\\uD800b", "[b-a]", "\\b{g}abc", "(?x)a b c"):
        assert literals.required(odd) is None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    lines = ["ΟΔΟΣΑ here", "ΟΔΟΣ", "ὈΔΥΣΣΕΎΣ x", "İstanbul İİİ", "axyz there", "a.b]c", "STRAßE straẞe", "no", "", "𝒳𝒴𝒵 𝒳𝒴𝒵"]
    lines += ["".join(rng.choice(LETTERS + "  ") for _ in range(rng.randrange(30))) for _ in range(700)]
    files = [(f"f{k}", "\n".join(lines[k::3])) for k in range(3)]
    return S.chunks_of(spark.createDataFrame(files, "path string, content string")), lines


def test_letters_find_themselves(spark, corpus):
    chunks, lines = corpus
    rng = random.Random(4)
    cut = lambda t: t[(a := rng.randrange(len(t) - 2)) : a + rng.randrange(3, 9)]
    asked = sorted({"ΟΔΟΣ", "ΣΣΕ", "İİİ", "𝒳𝒴𝒵", *(cut(t) for t in lines if len(t) > 3)})
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    found = S.search_literal(queries, chunks, S.trigram_index(chunks)).select("query_id", "path", "line_no")
    scan = S.search_scan(queries, S.lines_in(chunks), S.literal_match()).select("query_id", "path", "line_no")
    assert found.count() > len(asked) and found.exceptAll(scan).isEmpty() and scan.exceptAll(found).isEmpty()


def test_patterns_equal_a_scan(spark, corpus):
    chunks, _ = corpus
    asked = list(enumerate(["[a-z&&[^b]]xyz", "\\p{L}+here", "\\Qa.b]\\E", "\\hthere", "ΟΔΟΣ.? ?h?", "(İİ|ΔΟΣ)[ΑİI]", "(?i)strasse|STRAßE", "x|y", "[\\]a]\\.b"]))
    queries = spark.createDataFrame(asked, "query_id long, text string")
    found = S.search_regex(queries, asked, chunks, S.trigram_index(chunks)).select("query_id", "path", "line_no")
    scan = S.search_scan(queries, S.lines_in(chunks), S.regex_match()).select("query_id", "path", "line_no")
    assert found.count() > 10 and found.exceptAll(scan).isEmpty() and scan.exceptAll(found).isEmpty()


def same(found, expected):
    return found.exceptAll(expected).isEmpty() and expected.exceptAll(found).isEmpty()


@pytest.fixture(scope="module")
def trigrams(spark, corpus):
    return stored_search.write_trigrams(corpus[0], work_path(spark, "test-trigrams"))


@pytest.mark.parametrize("limits", [{}, {"MOST_KEYS": 5}, {"MOST_ROWS": 0}])
def test_stored_index_equals_a_scan(spark, corpus, trigrams, monkeypatch, limits):
    """Whether buckets are picked or all are read, and chunks are sent or shuffled."""
    for name, value in limits.items():
        monkeypatch.setattr(stored_search, name, value)
    chunks, lines = corpus
    rng = random.Random(5)
    asked = sorted({"ΟΔΟΣ", "not there", "ab", "𝒳𝒴𝒵", *(t[(a := rng.randrange(len(t) - 2)) : a + 5] for t in lines[::9] if len(t) > 3)})
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    scan = S.search_scan(queries.where("length(text) > 2"), S.lines_in(chunks), S.literal_match())
    found = stored_search.search_literal(queries, trigrams)
    assert found.count() > 50 and same(found, scan)
    assert same(stored_search.search_literal(queries, trigrams, F.col("path") != "f1"), scan.where("path <> 'f1'"))
    patterns = list(enumerate(["[a-z&&[^b]]xyz", "\\p{L}+here", "ΟΔΟΣ.? ?h?", "x|y"]))
    queries = spark.createDataFrame(patterns, "query_id long, text string")
    assert same(stored_search.search_regex(queries, patterns, trigrams), S.search_scan(queries, S.lines_in(chunks), S.regex_match()))
    assert same(stored_search.search_regex(queries.limit(0), [], trigrams), queries.limit(0).selectExpr("query_id", "'' path", "0 line_no", "text"))


def opened(rows):
    """The files that a read of one table opens."""
    rows.write.format("noop").mode("overwrite").save()
    plan = rows.sparkSession._jsparkSession.sessionState().executePlan(rows._jdf.logicalPlan(), rows.sparkSession._jvm.org.apache.spark.sql.execution.CommandExecutionMode.ALL()).executedPlan()
    plan.execute().count()
    return plan.collectLeaves().head().metrics().apply("numFiles").value()


def test_a_search_opens_its_buckets_only(spark, trigrams):
    picked, everything = trigrams.postings(["ere"]), trigrams.postings()
    assert "PartitionFilters: [isnotnull(bucket" in picked._jdf.queryExecution().toString()
    assert picked.count() == everything.where("tri = 'ere'").count() > 0
    assert opened(picked) <= 4 < 64 <= opened(everything) * 2
    assert opened(trigrams.chunks([1])) <= 1


def test_stored_words_equal_all_words(spark):
    rng = random.Random(6)
    words = ["readFile", "read", "file", "Ärger", "x1", "the", "of", "fileReader"]
    files = [(f"d/{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for k in range(60)] + [("e", ""), ("g", "rareWord")]
    files = spark.createDataFrame(files, "path string, content string")
    index = stored_search.write_words(files, work_path(spark, "test-words"))
    queries = spark.createDataFrame([(1, "readFile the"), (2, "rareWord"), (3, "nowhere"), (4, "fileReader Ärger x1")], "query_id long, text string")
    postings = S.word_index(files)
    stats = S.doc_stats(files, postings)
    found, expected = stored_search.bm25(queries, index), S.bm25(queries, postings, stats)
    assert found.count() > 20 and same(found, expected)
    within = F.col("path").startswith("d/1")
    assert same(stored_search.bm25(queries, index, within), S.bm25(queries, postings, stats, within))


def test_empty_indexes(spark):
    files = spark.createDataFrame([], "path string, content string")
    index = stored_search.write_trigrams(S.chunks_of(files), work_path(spark, "test-none"))
    queries = spark.createDataFrame([(1, "abc")], "query_id long, text string")
    assert stored_search.search_literal(queries, index).count() == 0
    assert stored_search.bm25(queries, stored_search.write_words(files, work_path(spark, "test-none"))).count() == 0
