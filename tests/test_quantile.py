import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parcelspark.operators.quantile import exact_medians, rank_medians


def _frame(spark, n=4000, seed=7):
    rng = np.random.default_rng(seed)
    # one hot group holding about a third of the rows, many small ones, repeated values, nulls
    g = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 60, n))
    a = rng.normal(100, 30, n).round(1)
    b = rng.integers(0, 5, n).astype(float)
    b[rng.random(n) < 0.2] = np.nan
    pdf = pd.DataFrame({"g": g.astype(int), "k": (g % 3).astype(int), "a": a, "b": b})
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                                "g int, k int, a double, b double")
    return pdf, sdf


def _expected(pdf, keys):
    return pdf.groupby(keys).agg(ma=("a", "median"), mb=("b", "median")).reset_index()


def _check(result, expected, keys):
    got = result.toPandas().sort_values(keys).reset_index(drop=True)
    exp = expected.sort_values(keys).reset_index(drop=True)
    assert len(got) == len(exp)
    for c in ["ma", "mb"]:
        assert np.allclose(got[c].astype(float), exp[c].astype(float), equal_nan=True, rtol=0, atol=1e-9)


def test_rank_path_matches_pandas(spark):
    pdf, sdf = _frame(spark)
    out = rank_medians(sdf, ["g", "k"], {"ma": "a", "mb": "b"})
    _check(out, _expected(pdf, ["g", "k"]), ["g", "k"])


def test_split_path_with_hot_group(spark):
    pdf, sdf = _frame(spark)
    # bound of 200 rows: group 0 (about 1,360 rows) takes the rank path, the rest the hash path
    out = exact_medians(sdf, ["g"], {"ma": "a", "mb": "b"}, hot_rows=200)
    _check(out, _expected(pdf, ["g"]), ["g"])


def test_invariant_to_partitioning(spark):
    pdf, sdf = _frame(spark, seed=11)
    a = rank_medians(sdf.repartition(1), ["g"], {"ma": "a", "mb": "b"})
    b = rank_medians(sdf.repartition(13, "a"), ["g"], {"ma": "a", "mb": "b"})
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_global_median(spark):
    pdf, sdf = _frame(spark, n=1001)
    out = rank_medians(sdf, [], {"ma": "a"}).first()["ma"]
    assert out == float(pdf["a"].median())


def test_kth_smallest(spark):
    import random
    from parcelspark.operators import quantile
    rng = random.Random(3)
    vals = [float(rng.randint(0, 50)) for _ in range(501)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    k = lambda n: F.floor(n / 2) + 1
    expected = sorted(v for v in vals if v is not None)[len([v for v in vals if v is not None]) // 2]
    got = quantile.kth_smallest(df.repartition(7), "v", k).first()
    assert got["value"] == expected and got["n"] == 501
    none = quantile.kth_smallest(df.where("v IS NULL"), "v", k).first()
    assert none["value"] is None and none["n"] == 0


def test_large_groups_of_nulls_stay(spark):
    rows = [(0, None)] * 30 + [(1, float(i)) for i in range(30)] + [(2, 4.0)]
    df = spark.createDataFrame(rows, "g int, a double")
    for bound in (1, 10, 1000):
        got = {r["g"]: r["ma"] for r in exact_medians(df, ["g"], {"ma": "a"}, hot_rows=bound).collect()}
        assert got == {0: None, 1: 14.5, 2: 4.0}


def test_metric_queries_do_not_depend_on_the_bound(spark, monkeypatch):
    from parcelspark.operators import quantile
    from parcelspark.plans.queries import QUERIES
    for name in ("q01_sales_district_year", "q03_sales_street_year", "q05_income_by_district", "q10_reference_dedupe"):
        expected = sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
        with monkeypatch.context() as m:
            m.setattr(quantile, "HOT_GROUP_ROWS", 1)
            assert sorted(map(str, QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == expected


def test_scale_conf_sizes_partitions():
    from parcelspark.session import scale_conf
    conf = scale_conf(100e12, 8000)
    assert int(conf["spark.sql.shuffle.partitions"]) > 300_000
    assert scale_conf(1e6, 8)["spark.sql.shuffle.partitions"] == "24"


def test_groups_of_two_values_hold_no_value_lists(spark, monkeypatch):
    """Beyond the bound of rows, only groups of more values go through the aggregate that holds them all."""
    from parcelspark.operators import histogram, quantile
    rows = [(g, float(v), None if v == 3 else float(g * v)) for g in range(40) for v in range(1 + g % 2)]
    deep = [(100, float(v), float(v % 3)) for v in range(9)] + [(101, 5.0, None)] * 4 + [(102, 1.0, 1.0), (102, 4.0, float("nan")), (102, 4.0, -0.0)]
    def run(data):
        df = spark.createDataFrame(data, "g int, a double, b double")
        held = histogram.value_histogram(df, {"x": histogram.Grain(["g"], {"a": "a", "b": "b"}, {"kind": F.lit("k")})}).cache()
        return histogram.group_metrics(held, "x", ["g"], medians={"ma": "a", "mb": "b"}, distinct={"kinds": "kind"}, shares={"k": "k"})
    whole = sorted(map(tuple, run(rows + deep).collect()))
    for bound in (1, 10):
        monkeypatch.setattr(quantile, "HOT_GROUP_ROWS", bound)
        assert sorted(map(tuple, run(rows + deep).collect())) == whole
    assert "percentile" not in run(rows)._jdf.queryExecution().toString()
    assert "percentile" in run(rows + deep)._jdf.queryExecution().toString()
