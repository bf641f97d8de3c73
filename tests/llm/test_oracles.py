"""Every query of the subpackage that has SQL, against it in DuckDB, on whole tables."""

import glob
import os

import duckdb
import pytest

from bayerloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
ODD = [
    (1, "", 1), (2, None, 1), (3, "!?!", 1), (3, "!?!", 1), (None, "one two", 0), (None, None, 0), (4, "One two", 0), (5, "naïve Ärger, 中文 x x x", 1), (6, "a a a a a a a", 1),
    (7, "a b c d e f g h i j k l m n o p q r s t u v w x y z", 1), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z.", 1), (9, "a b c d e f g h i j k l m n o p q r s t u v w x y 0", 0),
]


def same(spark, connection, name: str, folder: str) -> None:
    expected = connection.sql(ORACLE_SQL[name])
    rows = QUERIES[name](spark, folder)
    columns = sorted(rows.columns)
    assert columns == sorted(expected.columns)
    places = [expected.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == sorted(repr(tuple(r[i] for i in places)) for r in expected.fetchall())


def connected(folder: str):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{source}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    """To the last bit; the neighbours too, as graphs so small find all."""
    same(spark, connected(SF), name, SF)


@pytest.mark.parametrize("name", ["op2_weighted_minhash", "op6_importance_resampling", "op7_feistel_shards"])
def test_same_rows_of_odd_texts(spark, tmp_path, name):
    spark.createDataFrame([(d, t) for d, t, _ in ODD], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, q, 0) for d, _, q in ODD], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same(spark, connected(str(tmp_path)), name, str(tmp_path))
