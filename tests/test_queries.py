"""Every registered query against the SQL it must agree with."""

import decimal
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from bindery.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return round(float(x), 6) if isinstance(x, (float, decimal.Decimal)) else x


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    found = oracle.sql(SQL[name])
    assert sorted(found.columns) == columns
    rows = oracle.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({SQL[name]})").fetchall()
    assert got == Counter(tuple(map(plain, r)) for r in rows)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["name", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_constant_iri_reaches_the_scan(spark, capsys):
    QUERIES["bgp_const_iri"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(o_custkey,42)" in plan and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_star_is_one_scan_and_keys_join_as_integers(spark, capsys):
    QUERIES["flagship"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Scan parquet") - plan.count("(1) Scan parquet") <= 4 and "concat" not in plan


@pytest.mark.parametrize("name", ["minus_optional", "optional_two_unbound"])
def test_unbound_variables_need_no_nested_loop(spark, capsys, name):
    QUERIES[name](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
