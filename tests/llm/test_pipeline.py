"""The pipeline's stages, one after another, on the smallest tables."""

from conftest import SF


def test_stages_keep_the_columns_and_shrink(spark):
    import corpus_pipeline as p

    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = p.saved(stage(spark, docs, SF))
        assert docs.columns == first.columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = p.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_planted_cases(spark):
    import corpus_pipeline as p

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(120))
    rows = [(1, own(1)), (2, own(1)), (3, own(3)), (4, own(3) + " more"), (5, own(5)), (6, own(6)[:100] + " " + bench), (7, own(7))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = {r["doc_id"] for r in p.drop_near_duplicates(spark, docs, SF).collect()}
    assert near in ({1, 3, 5, 6, 7}, {1, 3, 4, 5, 6, 7}) and 2 not in near
    assert {r["doc_id"] for r in p.drop_contaminated(spark, docs, SF).collect()} == {1, 2, 3, 4, 5, 7}


def test_stages_with_odd_rows_and_clashing_columns(spark):
    import corpus_pipeline as p

    rows = [(1, None), (1, None), (2, ""), (3, "x"), (None, "no id, but a text of its own"), (None, "another one without"), (4, "la " * 500)]
    docs = spark.createDataFrame([(i, t, 0.5, 1, "v", 2) for i, t in rows], "doc_id long, text string, score double, predicted int, version string, gone int")
    for empty in (docs, docs.limit(0)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, empty, SF)
            assert out.columns == docs.columns
            ids = [r["doc_id"] for r in out.collect()]
            assert not ids if empty is not docs else ids.count(None) == 2 and 4 in ids


def test_no_text_is_lost_or_kept_for_another_of_its_id(spark):
    """Two texts under one id, a clean row whose id a contaminated one shares, and a contaminated row without an id."""
    import corpus_pipeline as p

    bench, other = (r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").take(2))
    own = lambda i: " ".join(f"u{i}x{j}" for j in range(60))
    rows = [(1, own(1)), (1, own(2)), (2, own(3)), (2, bench), (None, "x " + other + " y"), (None, own(4)), (3, own(1))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES[1:4]:
        docs = p.saved(stage(spark, docs, SF))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == sorted([(1, own(1)), (1, own(2)), (2, own(3)), (0, own(4))])


def test_contaminated_documents_without_an_id_go(spark):
    import corpus_pipeline as p

    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(None, "x " + bench), (None, "a text of its own"), (None, None), (1, bench), (1, "another text of the same id")], "doc_id long, text string")
    kept = {(r["doc_id"], r["text"]) for r in p.drop_contaminated(spark, docs, SF).collect()}
    assert kept == {(None, "a text of its own"), (None, None), (1, "another text of the same id")}
