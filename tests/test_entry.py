"""The driver's contract, and the catalogue's queries on the smallest tables against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__
from glyphgrid.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations events embeddings".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(catalogue.QUERIES) <= set(queries) and set(sql) <= set(queries)


@needs_data
@pytest.mark.parametrize("name", ["geometry_align_flagship", "match_counts", "exact_candidates", "fuzzy_windows", "yolo_parse", "json_text_regions", "label_studio_export", "alto_xml_words", "render_plan"])
def test_against_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    catalogue.QUERIES[name](spark, SMALL).write.parquet(str(tmp_path / "r"))
    con.execute(f"CREATE TABLE r AS SELECT * FROM '{tmp_path}/r/*.parquet'")
    con.execute(f"CREATE TABLE o AS {catalogue.ORACLES[name]}")
    kinds = [sorted(x[:2] for x in con.execute(f"DESCRIBE {t}").fetchall()) for t in "ro"]
    assert kinds[0] == kinds[1]
    columns = ", ".join(f'"{c}"' for c, _ in kinds[0])
    for a, b in ("ro", "or"):
        assert con.execute(f"SELECT count(*) FROM (SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b})").fetchone() == (0,)


@needs_data
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
