"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from docweave.queries import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    null = lambda v: v is None or v is pd.NaT or isinstance(v, (float, np.floating)) and np.isnan(v)
    shown = lambda v: "NULL" if null(v) else repr(float(v)) if isinstance(v, (float, np.floating)) else str(v)
    return sorted(tuple(map(shown, r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) and len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_dehyphenated_cells_reads_whole_texts(spark, tmp_path):
    """A word wrapped beyond the first 200 characters is joined too."""
    from docweave.queries.layout_queries import dehyphenated_cells

    text = "Anfang. " * 40 + "Daten bank"
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = dehyphenated_cells(spark, str(tmp_path)).first()
    assert row.changed and row.text.endswith(" Daten-bank")


def test_node_provenance_of_parts_with_equal_names(spark, tmp_path):
    """Chunk names keep six places of a part's key; parts of equal names have their own kinds and captions."""
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT 1000000 + i AS p_partkey, 'part ' || i AS p_name, 'Brand#' || i AS p_brand, (i * 7 % 50)::INTEGER AS p_size FROM range(40) t(i)")
    con.execute("CREATE TABLE lineitem AS SELECT 100 + i AS l_orderkey, 1000000 + i * 3 % 40 AS l_partkey, i % 3 AS l_suppkey FROM range(60) t(i)")
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = registry.queries()["node_provenance"](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.oracle_sql()["node_provenance"]).df()
    assert rows(got) == rows(want)
