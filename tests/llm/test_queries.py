"""Every registered query of the training-data operators on a whole small table, against its SQL where there is one."""

import duckdb
import pytest

from millrace.llm import queries

#: The smallest table of documents holds no secrets.
SF, SECRETS_SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(str([row[c] for c in sorted(row)]) for row in rows)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SECRETS_SF if name == "op5_secrets" else SF).toArrow().to_pylist()
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        assert plain(got) == plain(con.sql(queries.ORACLES[name]).to_arrow_table().to_pylist())
