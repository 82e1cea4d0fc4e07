"""The pipeline and the registered queries over the small tables."""

import duckdb
import pytest

import corpus_pipeline
from treeledger.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_cover_their_table_and_agree_with_sql(spark, con, name):
    df = queries.queries()[name](spark, FOLDER)
    rows = sorted(map(str, (tuple(row[c] for c in sorted(df.columns)) for row in df.collect())))
    if name in oracle.oracle_sql():
        result = con.execute(oracle.oracle_sql()[name])
        names = [d[0] for d in result.description]
        order = [names.index(c) for c in sorted(df.columns)]
        assert rows == sorted(str(tuple(row[i] for i in order)) for row in result.fetchall())
    elif name != "op4_neighbours":
        assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]


def test_pipeline_keeps_columns_and_is_the_same_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns
        docs = corpus_pipeline.written(after)
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) == docs.count()
    starts = sorted((row.start, row.n_tokens) for row in rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_one_row_of_each_group_of_copies_stays_whatever_its_id(spark):
    text, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    near = text.replace("w39", "x")
    rows = [(1, text), (1, text), (2, text), (None, text), (None, near), (3, other), (4, None), (4, None), (None, "")]
    docs = spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, _doc_id string, row string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    got = sorted(r.text or "" for r in kept.collect())
    assert len(got) == 5 and got[:3] == ["", "", ""] and got[3] == other and got[4] in (text, near)
