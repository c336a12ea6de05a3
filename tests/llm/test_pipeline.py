"""The pipeline's stages on a small fixture, each against its own statement."""

import corpus_pipeline as P
from trendloom.llm import queries

LONG = " ".join(f"word{i}" for i in range(70))


def test_registration():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert [n for n, _ in P.STAGES] == ["quality", "lines", "near_duplicates", "mixture", "packing"]


def test_stages_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= ids and kept
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 0").collect()}
            assert len(kept & bad) <= 0.1 * len(bad) and len(kept) >= 0.8 * len(ids - bad)
        if name == "lines":
            assert kept == ids


def test_lines_and_near_duplicates_take_effect(spark, sf_dir):
    near = LONG.replace("word35", "other")
    rows = [(1, f"one\n{LONG}", "en", "a", 1), (2, f"two\n{LONG}\nthree", "en", "a", 1), (3, None, "en", "a", None), (4, "", "en", "a", 0), (None, "no id here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lines = {r.doc_id: r for r in P.lines_stage(spark, docs, sf_dir).collect()}
    assert lines[1].text == f"one\n{LONG}" and lines[2].text == "two\nthree" and lines[2].n_chars == 9 and lines[3].text is None
    pairs = [(5, LONG, "en", "a", 1), (6, LONG, "en", "a", 1), (7, near + " tail", "en", "a", 1), *rows[2:]]
    kept = {r.doc_id for r in P.near_duplicates_stage(spark, spark.createDataFrame(pairs, docs.schema), sf_dir).collect()}
    assert 5 in kept and 6 not in kept and 3 in kept and 4 not in kept and None in kept


def test_run_equals_the_stages(spark, sf_dir):
    out = P.run(spark, sf_dir).toPandas()
    assert (out["length"] > 0).all() and (out["offset"] + out["length"] <= 2048).all()
    whole = out.groupby("sequence_id")["length"].sum()
    ends = (out["offset"] + out["length"]).groupby(out["sequence_id"]).max()
    assert (whole == ends).all()
