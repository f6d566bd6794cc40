"""op11 to op13 against their DuckDB SQL over whole tables."""

import duckdb
import pytest

from cellweave.llm import queries

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_rule_ledger", "op13_merkle_manifest"])
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    got = queries.queries()[name](spark, D)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cur.fetchall())
