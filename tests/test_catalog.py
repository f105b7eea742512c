"""Every registered query of the library's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from tabloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def text(v):
        return "" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, sql, name):
    df = catalog.QUERIES[name](spark, data)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    want = sql.sql(catalog.SQL[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    assert plain([[r[n] for n in names] for r in rows]) == plain(want.project(", ".join(f'"{n}"' for n in names)).fetchall())


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_whole_tables_are_read(spark, data):
    for parts, name in ((catalog.halves(spark, data, "l_orderkey", "l_linenumber"), "lineitem"), (catalog.order_parts(spark, data), "orders")):
        a, b = parts
        assert plain(a.unionByName(b).collect()) == plain(catalog.table(spark, data, name).select(*a.columns).collect())
    assert len(catalog.long_to_wide(spark, data).columns) == 13
    assert catalog.assemble_records(spark, data).count() == catalog.table(spark, data, "customer").count()
    assert {r.query_id for r in catalog.knn_neighbors(spark, data).collect()} == {r.p_partkey for r in catalog.table(spark, data, "part").where("p_partkey % 50 = 0").collect()}


def test_unknown_codes_of_odd_keys_decode_to_the_mode(spark, data):
    own = {r.o_orderkey: r.o_orderpriority for r in catalog.table(spark, data, "orders").collect()}
    found = catalog.binary_decode_mode(spark, data).collect()
    mode = min(set(own.values()), key=lambda v: (-list(own.values()).count(v), v))
    assert len(found) == len(own) and {r.o_orderkey: r.o_orderpriority for r in found} == {k: mode if k % 2 else v for k, v in own.items()}
