"""Recall of the index, accuracy of language identification, and the pipeline as a whole."""

import random

import numpy as np
from pyspark.sql import functions as F

from tracelake.llm import language_id, permutation_index

SF = "/root/testdata/sf0.001"


def brute(ids, vectors, queries, k=5):
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    out = {}
    for q in queries:
        s = unit @ unit[q]
        out[ids[q]] = [int(ids[j]) for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


def test_recall_and_order(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 16))
    v = centres[r.integers(0, 12, 1500)] + 0.6 * r.normal(size=(1500, 16))
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), [float(x) for x in row], 1) for i, row in zip(ids, v, strict=True)], "vec_id bigint, embedding array<double>, label int")
    got = permutation_index.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    want = brute(ids, v, range(0, 1500, 50))
    found = {}
    for x in got:
        found.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert all(len(x) == 5 and all(a[1] >= b[1] for a, b in zip(x, x[1:], strict=False)) for x in found.values())
    assert np.mean([len({j for j, _ in found[q]} & set(want[q])) / 5 for q in want]) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (50, [2.0, 0.0]), (8, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in permutation_index.nearest(df, F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").select("query_id", "rank", "vec_id").collect()]
    assert got == [(0, 1, 7), (0, 2, 50), (50, 1, 0), (50, 2, 7)]
    assert permutation_index.nearest(df.limit(0), F.lit(True)).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit_documents(docs.where("doc_id % 2 = 0"))
    rest = docs.where("doc_id % 2 = 1")
    got = language_id.identify(language_id.document_rows(rest), ["doc_id"], model).join(rest.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    assert len(got) == rest.count() and np.mean([r.lang == r.truth for r in got]) > 0.97


def test_other_evidence_decides_short_texts(spark):
    r = random.Random(2)
    parts = {"aa": ["ka", "ko", "ki"], "bb": ["zu", "ze", "zy"]}
    text = lambda x: " ".join("".join(r.choices(parts[x], k=3)) for _ in range(40))
    labelled = spark.createDataFrame([(i, text("aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(60)], "id bigint, text string, lang string")
    model = language_id.fit(labelled)
    rows = [(i, text("aa"), "aa", "x", "h1") for i in range(40)] + [(100 + i, text("bb"), "bb", "y", "h2") for i in range(40)]
    rows += [(200, "mm", None, None, "h1"), (201, "mm", None, None, "h2"), (202, "mm", "bb", None, None), (203, None, "aa", "x", "h1"), (204, "", None, None, None), (205, "123", None, "y", None), (0, rows[0][1], "aa", "x", "h1")]
    df = spark.createDataFrame(rows, "key bigint, text string, declared string, suffix string, host string")
    got = {x.key: x for x in language_id.identify(df, ["key"], model).collect()}
    assert (got[200].lang, got[201].lang, got[202].lang) == ("aa", "bb", "bb")
    assert not got[203].accepted and got[203].lang == "aa" and not got[204].accepted and got[205].lang == "bb"
    assert language_id.identify(df, ["key"], model).count() == len(rows)


def test_nothing_labelled(spark):
    model = language_id.fit(spark.createDataFrame([(1, "a", None)], "id bigint, text string, lang string"))
    df = spark.createDataFrame([(1, "a", None, None, None)], "key bigint, text string, declared string, suffix string, host string")
    assert [tuple(r) for r in language_id.identify(df, ["key"], model).collect()] == [(1, None, 0.0, False)]


def test_page_rows(spark):
    html = "<html lang='fr-FR'><script>var x='<p>'</script><!-- no --><p>bon jour</p></html>"
    r = language_id.page_rows(spark.createDataFrame([(1, "https://user@Blog.Example.org:80/x", html), (2, None, None)], "page_id bigint, url string, html string")).orderBy("page_id").collect()
    assert (r[0].declared, r[0].suffix, r[0].host, r[0].text.split()) == ("fr", "org", "blog.example.org", ["bon", "jour"]) and r[1].host is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF).persist()
        assert kept.columns == columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[0] >= 0.99 * docs.count()
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in kept.select("doc_id").collect()} and all(r.lossless for r in out)
    copies = docs.groupBy("text").agg(F.min("doc_id").alias("first"), F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    ids = {r.doc_id for r in out}
    assert copies and all(not (set(r.ids) - {r.first}) & ids for r in copies)


def test_recall_on_the_given_vectors(spark):
    """2,000 vectors that are close to random: the five nearest, with a twenty-fifth of the rows reranked."""
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = permutation_index.usable(vectors).collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    queries = np.flatnonzero(ids % 50 == 0)
    want = brute(ids, v, queries)
    got: dict = {}
    for r in permutation_index.nearest(vectors, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(queries) >= 40 and all(len(got[ids[q]]) == 5 for q in queries)
    assert np.mean([len(set(got[ids[q]]) & set(want[ids[q]])) / 5 for q in queries]) >= 0.9
