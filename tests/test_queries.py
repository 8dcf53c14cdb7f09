"""Every registered query of the reference's operators against its DuckDB oracle."""

import math
import os

import duckdb
import pytest

from docsmelt.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLE_SQL[name])
    want = plain(found.fetchall(), [c[0] for c in found.description])
    assert plain([tuple(r) for r in df.collect()], df.columns) == want


@pytest.mark.parametrize(
    "rows, want",
    [
        ([(1, "ABC!! ñare")], [(1, "emphasis", "fallback", "ABC", 0.351)]),
        ([(1, "ABC!! éabout")], [(1, "emphasis", "fallback", "ABC", 0.27)]),
        ([(1, "ABC!! aré isß áre is_")], [(1, "emphasis", "fallback", "ABC", 0.351)]),
        ([(1, "ABC!! İS")], [(1, "emphasis", "fallback", "ABC", 0.351)]),
        ([(1, "ABC!! İare")], [(1, "emphasis", "fallback", "ABC", 0.324)]),
        ([(1, 'about token = "' + "0a1b2c3d" * 5 + '"'), (1, "the token is " + "9f" * 16)], [(1, "token", "main", "0a1b2c3d" * 5, 0.405)]),
    ],
)
def test_fallback_library_beside_other_letters_and_over_rows_of_one_id(spark, tmp_path, rows, want):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert con.execute(ORACLE_SQL["fallback_library"]).fetchall() == want
    assert [tuple(r) for r in QUERIES["fallback_library"](spark, str(tmp_path)).collect()] == want
