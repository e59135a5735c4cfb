"""The pipeline's stages one after another, and the queries with SQL."""

from __future__ import annotations

from pathlib import Path

import pytest

from strataforge.llm import queries
from tests.compare import duck, rows

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    df = queries.queries()[name](spark, DATA)
    want = duck(DATA).sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_pipeline_on_planted_cases(spark, tmp_path):
    import corpus_pipeline

    same = "this line stands in many of the documents of the table"
    body = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    docs = [(k, f"{body(k)}\n{same}", "en", "a" if k % 2 else "b", 0) for k in range(8)]
    docs += [(20, body(3), "en", "a", 0), (21, body(3).replace("word3x79", "other"), "en", "a", 0), (30, "?!", "en", "a", 0), (31, None, "en", "b", 0), (32, same, "en", "b", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    now = df
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        path = str(tmp_path / name.replace(" ", "_"))
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
        if name != "packing":
            assert now.columns == df.columns
    ids = lambda n: sorted(r["doc_id"] for r in seen[n].select("doc_id").distinct().collect())
    assert ids("language ID") == [*range(8), 20, 21, 32]
    assert ids("line dedup") == [*range(8), 20, 21, 32]
    assert all(same not in r["text"] for r in seen["line dedup"].where("doc_id < 8").collect())
    assert ids("n-gram Jaccard join") == [*range(8), 32]
    assert set(ids("packing")) == set(ids("mixing sources")) <= {*range(8), 32}
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == seen["packing"].columns


def test_pipeline_without_languages(spark, tmp_path):
    """With lang null in all rows nothing can be learned: documents with letters stay, others go."""
    import corpus_pipeline

    body = lambda k: " ".join(f"word{k}x{i}" for i in range(80))
    docs = [(k, body(k), None, "a" if k % 2 else None, None) for k in range(6)] + [(10, "?! 12 ½", None, "a", 0), (11, None, None, "a", 0), (12, "日本", None, "a", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, df, str(tmp_path)).collect()) == [*range(6), 12]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_stages_with_odd_rows_and_columns(spark, tmp_path):
    """Null ids, repeated rows, null columns and columns whose names the operators use, too; empty tables."""
    import corpus_pipeline

    body = lambda k: " ".join(f"word{k}x{i}" for i in range(60))
    docs = [(None, body(0), "en", None, None, "q", 1), (None, body(0), "en", None, None, "q", 1), (None, body(1), None, "a", 0, None, 2), (5, body(2), "en", "a", 0, "z", 3), (5, body(2), "en", "a", 0, "z", 3), (5, None, None, None, None, None, None), (6, "", "en", "b", 0, "y", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, node string, size int")
    kept = {"language ID": 5, "line dedup": 5, "n-gram Jaccard join": 3}
    now = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).persist()
        assert now.columns == df.columns, name
        assert now.count() == kept.get(name, now.count()), name
        assert stage(spark, df.where("false"), str(tmp_path)).count() == 0, name
    assert corpus_pipeline.pack(spark, now, str(tmp_path)).agg({"length": "sum"}).first()[0] > 0
    assert corpus_pipeline.pack(spark, df.where("false"), str(tmp_path)).count() == 0
