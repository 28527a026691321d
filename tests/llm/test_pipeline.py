import corpus_pipeline
from axonwave.llm import queries


def test_stages(spark, tmp_path):
    letters = str.maketrans("0123456789", "abcdefghij")  # digits are all alike to the line dedup
    words = lambda k, n: " ".join(f"w{(k * 7919 + i * i * 31) % 5003}".translate(letters) for i in range(n))
    rows = [(i, words(i, 60 + i), "en", f"s{i % 3}", 0) for i in range(40)] + [(100 + i, words(i, 60 + i), "en", "s0", 0) for i in range(5)] + [(200, None, None, None, None), (201, "too short", "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    a = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert ids(a) == {*range(40), *range(100, 105)} and a.columns == docs.columns
    b = corpus_pipeline.line_dedup(spark, a, str(tmp_path))
    assert ids(b) == set(range(40))
    assert ids(corpus_pipeline.near_duplicates(spark, a, str(tmp_path))) == set(range(40))
    c = corpus_pipeline.mixing(spark, b, str(tmp_path))
    assert c.columns == docs.columns and c.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in c.collect()) and all(r.n_tokens == len(r.ids) for r in out)


def test_lines_of_many_documents_go_from_large_sources(spark, tmp_path):
    own = lambda i: " ".join(f"w{(i * 7919 + k * k * 31) % 5003}" for k in range(40))
    boiler = "the same notice on many a page of this host"
    rows = [(i, own(i) + ("\n" + boiler if i % 10 == 0 else ""), "en", "large", 0) for i in range(400)] + [(1000 + i, own(i) + ("\nsmall notice" if i < 6 else ""), "en", "small", 0) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert got == {r[0]: r[1].split("\n")[0] for r in rows}


def test_short_lines_of_their_own_stay(spark, tmp_path):
    notice = "This work is under a licence of five words"
    rows = [(1, notice + "\nfirst"), (2, notice + "\nroses are red\n\nviolets blue"), (3, notice + "\n -- "), (4, notice + "\n\u6211\u4eec\u53bb")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "roses are red\n\nviolets blue", 4: "\u6211\u4eec\u53bb"}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in queries.queries()["op10_line_dedup"](spark, str(tmp_path)).collect() if r.dropped} == {3}


def test_registry():
    assert len(queries.queries()) == 12 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"
