"""The pipeline's stages against brute force on the smallest tables."""

import corpus_pipeline as P
from textledger.llm import cotraining, fm_index, mixing
from textledger.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.columns[:5] == P.COLUMNS
    quality, near, bench, secret, mixed = kept
    scores = {r.doc_id: r.keep for r in cotraining.op10_quality(spark, SF).collect()}
    assert set(quality) == {i for i, keep in scores.items() if keep}

    sets = {}
    for i, r in quality.items():
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert set(near) == {i for i in comp if comp[i] == i}

    grams = set()
    for r in table(spark, SF, "benchmark").collect():
        w = fm_index.words_of(r.text)
        grams |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    width = {len(g) for g in grams}
    dirty = {i for i, r in near.items() for w in [fm_index.words_of(r.text)] if any(tuple(w[k : k + n]) in grams for n in width for k in range(len(w) - n + 1))}
    assert set(bench) == set(near) - dirty and dirty

    assert set(secret) == set(bench)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in secret.values())
    assert any("[SECRET]" in (r.text or "") for r in secret.values())
    assert set(mixed) <= set(secret) and all(1 <= r.copies <= 2 for r in mixed.values())


def test_awkward_rows(spark):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string")
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == P.COLUMNS
        docs.collect()
    P.STAGES[-1][1](spark, docs, SF).collect()


def test_one_row_of_each_group(spark):
    """Rows are told apart, whatever their ids."""
    words = [f"w{k}" for k in range(60)]
    body, other = " ".join(words), " ".join(f"v{k}" for k in range(60))
    rows = [(1, body, "a"), (1, body, "b"), (2, body, "c"), (None, body, "d"), (None, other, "e"), (5, f"{other} more", "f"), (7, "", "g"), (7, None, "h"), (None, "", "i"), (3, "lone words here", "j"), (3, "other words there", "k")]
    docs = spark.createDataFrame([(i, t, n, "s", 0) for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(r.lang for r in P.near_duplicates(spark, docs, SF).collect())
    assert got in (["a", "f", "g", "h", "i", "j", "k"], ["b", "f", "g", "h", "i", "j", "k"])


def test_mixture_meets_its_targets(spark):
    """Half of the rows without id, ids that repeat: each row has its own copies, and the sources come near their targets."""
    rows = [(k % 50 if k % 2 else None, " ".join(["x"] * (1 + k % 37)), "en", f"s{k % 3}", 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.mixture(spark, docs, SF).collect()
    taken, target = {}, {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.copies * len(r.text.split())
    assert len(got) <= len(rows) and set(taken) == set(target)
    assert all(abs(taken[s] - target[s]) <= 19 for s in target)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_run_is_its_stages(spark):
    """The written stages, one behind the other, give what run() gives."""
    docs = table(spark, SF, "documents")
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
    assert sorted(r.doc_id for r in P.run(spark, SF).collect()) == sorted(r.doc_id for r in docs.collect())
