"""Registered queries read whole tables: no subset of ids in program or SQL."""

from pathlib import Path

import duckdb
import pytest

from ruleframe import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")

IDS = {
    "rec_shortest_path": "SELECT n_nationkey FROM nation",
    "rec_path_counts": "SELECT n_nationkey FROM nation",
    "join_map_key": "SELECT n_nationkey FROM nation",
    "join_self_product": "SELECT DISTINCT l_suppkey FROM lineitem",
    "obj_frame_method": "SELECT DISTINCT l_suppkey FROM lineitem",
    "type_tests": "SELECT c_custkey FROM customer",
    "join_asof_idiom": "SELECT DISTINCT p.user_id FROM events p JOIN events v ON p.user_id = v.user_id AND v.event_id <= p.event_id WHERE p.event_type = 'purchase' AND v.event_type = 'view'",
}


def normal(rows):
    return sorted(tuple(float(x) if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(IDS))
def test_all_ids_answer(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert {r[0] for r in rows} == {r[0] for r in con.execute(IDS[name]).fetchall()}
    found = con.execute(queries.ORACLE_SQL[name])
    order = [d[0] for d in found.description]
    assert normal([r[c] for c in order] for r in rows) == normal(found.fetchall())
