"""What the pipeline leaves of copies, on a table with many of them and on rows without usable ids."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_copies_with_short_lines_leave_no_stub(spark):
    import corpus_pipeline

    long, other = "a line that is long enough to take part", "another line that is long enough for it"
    rows = [(1, f"{long}\nMent que."), (2, f"{long}\nMent que."), (3, f"{long[:-1]}\nMent que."), (4, f"{long}\n{other}\nshort"), (5, "Ment que."), (6, f"{long}\n \t ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert out == {1: rows[0][1], 4: f"{other}\nshort"}


def test_no_later_copy_is_encoded(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = corpus_pipeline.identify_language(spark, docs, SF).select("doc_id", "text").persist()
    copies = told.groupBy("text").agg(F.min("doc_id").alias("first"), F.collect_list("doc_id").alias("ids")).where("size(ids) > 1").collect()
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    later = [i for r in copies for i in r.ids if i != r.first]
    assert len(later) > 500 and not ids & set(later)


IDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def test_decontamination_with_null_and_repeated_ids(spark):
    from tracelake.llm import decontaminate

    items = [(k, " ".join(f"item{k}word{j}" for j in range(14))) for k in range(4)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(None, "before " + items[0][1]), (None, items[2][1] + " " + items[3][1]), (None, "clean"), (None, None), (7, items[1][1]), (7, items[1][1]), (7, "another text " + items[3][1]), (8, "clean")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    docs = docs.withColumn("_row", F.lit(5))
    found = decontaminate.decontaminate(docs, bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items), tuple(r.runs), r.contaminated) for r in found.collect()), key=str)
    want = [(None, 15, 14, (0,), (1, 15), True), (None, 28, 28, (2, 3), (0, 28), True), (None, 1, 0, (), (), False), (None, 0, 0, (), (), False)]
    want += [(7, 14, 14, (1,), (0, 14), True)] * 2 + [(7, 16, 14, (3,), (2, 16), True), (8, 1, 0, (), (), False)]
    assert got == sorted(want, key=str)


def test_unique_lines_of_rows_that_share_ids_stay(spark):
    import corpus_pipeline

    x = "a line that stands in two rows"
    for i in (None, 7):
        docs = spark.createDataFrame([(i, f"{x}\nunique A", "en", "s", 1), (i, f"y\n{x}", "en", "s", 1)], IDS)
        out = "\n".join(r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect())
        assert sorted(out.split("\n")) == sorted([x, "unique A", "y"])


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    some = spark.read.parquet(f"{SMALL}/documents.parquet").select(*[x.split()[0] for x in IDS.split(", ")])
    told = corpus_pipeline.identify_language(spark, some, SMALL)
    mixed = some.withColumn("doc_id", F.expr("case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 1 else doc_id end"))
    again = corpus_pipeline.identify_language(spark, mixed, SMALL)
    assert sorted(r.text for r in again.select("text").collect()) == sorted(r.text for r in told.select("text").collect())
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(None, f"x {item}", "en", "s", 1), (None, "clean", "en", "s", 1), (3, "clean too", "en", "s", 1), (3, item, "en", "s", 1)], IDS)
    assert sorted(r.text for r in corpus_pipeline.drop_contaminated(spark, docs, SMALL).collect()) == ["clean", "clean too"]
