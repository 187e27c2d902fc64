"""Every registered query against its DuckDB twin at sf0.001, and plan-shape checks."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import duckdb_con, table_hash

SF = "/root/testdata/sf0.001"
# the training-data operators have their own tests in tests/llm
QUERIES = {name: fn for name, fn in entry.queries().items() if name in entry.QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert name in ORACLE, "every registered query has a SQL twin"
    res = con.execute(ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    expected = res.fetchall()
    assert len(rows) == len(expected)
    assert table_hash(df.columns, rows)[0] == table_hash(cols, expected)[0]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q02_sales_quarter_year", "q15_point_in_polygon",
                                  "q16_weighted_exposure", "q17_line_overlay", "q26_map_street"])
def test_spatial_plans_have_no_cartesian_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_evaluation(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "median_price_m2" in df.columns


def test_filters_and_pruning_reach_the_scans(spark):
    import contextlib
    import io
    from parcelspark.plans.queries import cleaned_sales
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        cleaned_sales(spark, SF).explain("formatted")
    sections = buf.getvalue().split("Scan parquet")[1:]
    lineitem = next(s for s in sections if "lineitem.parquet" in s.split("ReadSchema")[0])
    part = next(s for s in sections if "part.parquet" in s.split("ReadSchema")[0])
    pushed = lambda sec: sec.split("PushedFilters:")[1].split("\n")[0]
    schema = lambda sec: sec.split("ReadSchema:")[1].split("\n")[0]
    assert "EqualTo(l_linestatus,F)" in pushed(lineitem) and "GreaterThan(l_quantity,10.0)" in pushed(lineitem)
    assert "GreaterThan(l_extendedprice,10000.0)" in pushed(lineitem)
    assert "In(p_type" in pushed(part)
    for unused in ["l_discount", "l_tax", "l_returnflag", "l_shipdate"]:
        assert unused not in schema(lineitem)


def test_spatial_first_match_is_a_hash_aggregate(spark):
    plan = _plan(QUERIES["q15_point_in_polygon"](spark, SF))
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert "min(_ord" in plan


def test_every_query_documents_its_work():
    missing = [name for name, fn in QUERIES.items() if not (fn.__doc__ or "").strip()]
    assert not missing, missing
