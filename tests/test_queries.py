"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from rollsift.plans import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else repr(round(float(v), 9) + 0.0)
    return str(v)


#: Queries whose results hang on an order along many rows.
ORDERED = "s1_tagged o1_weighted_schedule o3_round_robin o4_interleave_all o4_interleave_first o5_interleave_by_probability o6_epoch_order o18_exact_sample t1_by_run_and_length t7_report_order t8_batches t9_token_batches j8_previous j9_longest_prefix p11_cat_packs x2_sink x8_resumed".split()


@pytest.mark.parametrize("name", ORDERED)
def test_many_ranges_give_the_same(ranges, sql, name):
    """The same over sixteen partitions that nothing puts together again."""
    test_same_as_sql(ranges, sql, name)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sql, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    got = df.collect()
    answer = sql.execute(queries.SQL[name])
    columns = [d[0] for d in answer.description]
    want = answer.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got)
    b = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in want)
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0
