"""Readers under load and on awkward files: headers, split documents, link batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.sources import readers, records


@pytest.fixture
def small_splits(spark):
    """Splits of about a thousand bytes, so that records cross them everywhere."""
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "1201")
    yield
    spark.conf.unset(key)


def _features(n, rng):
    odd = ['pl{ain', 'a "quoted" }name', "back\\slash\\", "}}{{", "é☃\U0001F600", "", 'ends with \\"', "tab\tand\nline"]
    out = []
    for i in range(n):
        ring = [[rng.random(), rng.random()] for _ in range(rng.choice([4, 4, 40]))]
        kind = rng.choice(["Polygon", "MultiPolygon"])
        out.append({"type": "Feature", "geometry": {"type": kind, "coordinates": [ring] if kind == "Polygon" else [[ring]]},
                    "properties": {"id": str(i), "name": rng.choice(odd), "nested": None, "na{me": rng.choice(odd)}})
    return out


@pytest.mark.parametrize("indent", [None, 1])
def test_documents_split_over_tasks_give_all_features(spark, tmp_path, small_splits, indent):
    rng = random.Random(indent)
    expected = {}
    for k in range(3):
        features = _features(60, rng)
        document = {"type": "FeatureCollection", "name": "a { b", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features,
                    "more": {"type": "other"}}
        if k == 1:
            document = {"features": features, "type": "FeatureCollection"}
        text = json.dumps(document, indent=indent, ensure_ascii=k == 2)
        (tmp_path / f"layer {k}.geojson").write_text("﻿" * (k == 2) + text + "\n" * k, encoding="utf-8")
        expected.update({(k, f["properties"]["id"]): f for f in features})
    (tmp_path / "empty.geojson").write_text("")
    (tmp_path / "none.geojson").write_text('{"type": "FeatureCollection", "features": []}')
    out = readers.read_geojson(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got = records.feature_texts(spark, str(tmp_path)).select("file", F.from_json("text", readers.FEATURE_SCHEMA).alias("f")).where("f.type = 'Feature'").collect()
    assert len(got) == out.count() == len(expected)
    for row in got:
        k = int(row["file"].split("layer%20")[1][0])
        f = expected[(k, row["f"]["properties"]["id"])]
        assert row["f"]["properties"] == f["properties"]
        assert row["f"]["geometry"]["type"] == f["geometry"]["type"]
        assert json.loads(row["f"]["geometry"]["coordinates"]) == f["geometry"]["coordinates"]


def test_quoted_text_split_over_tasks(spark, tmp_path, small_splits):
    rng = random.Random(2)
    rows = [(f"{i}", rng.choice(['pl;ain', 'two\nlines', 'a ""quoted"" name', "", "x\n\n;y", "é"]), "z" * rng.randrange(60)) for i in range(300)]
    text = "﻿key;\"first name\";last;unused\n" + "".join(f'{a};"{b}";{c};u\n' for a, b, c in rows)
    (tmp_path / "t.csv").write_text(text, encoding="utf-8")
    out = records.read_quoted_csv(spark, str(tmp_path / "t.csv"), ["last", "key", "first name"])
    got = {r["key"]: (r["first name"] or "", r["last"] or "") for r in out.collect()}
    assert got == {a: (b.replace('""', '"'), c) for a, b, c in rows}
    with pytest.raises(ValueError):
        records.read_quoted_csv(spark, str(tmp_path / "t.csv"), ["other"])


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    folder = tmp_path / "sales 2024"
    folder.mkdir()
    columns = readers.RAW_SALES_COLUMNS
    for i in range(400):
        names = columns if i % 2 else columns[::-1]
        body = "".join(",".join(f"{c[:2]}{i}" for c in names) + "\n" for _ in range(1 + i % 3))
        (folder / f"vf-2024-{i}.csv").write_text(",".join(names) + "\n" + body, encoding="utf-8")
    (folder / "vf-2024-empty.csv").write_text("")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    groups = readers.files_by_header(spark, str(folder))
    jobs = tracker.getJobIdsForGroup("headers")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2 and sorted(map(len, groups.values())) == [200, 200]
    sales = readers.read_sales(spark, str(folder))
    assert sales.count() == sum(1 + i % 3 for i in range(400))
    assert sales.where("year <> 2024").count() == 0
    wrong = [c for c in columns if sales.where(~F.col(f"`{c}`").startswith(c[:2])).count()]
    assert not wrong


def test_headers_where_files_share_tasks(spark, tmp_path, monkeypatch):
    """A cluster that deals files its own way still gives every file's header."""
    for i in range(30):
        (tmp_path / f"f{i}.csv").write_text(f"head {i % 4}\n" + "body\n" * (i * 40), encoding="utf-8")
    from contextlib import nullcontext
    monkeypatch.setattr(readers, "_settings", lambda *a, **k: nullcontext())
    heads = readers.first_lines(spark, str(tmp_path))
    assert sorted(heads.values()) == sorted(f"head {i % 4}" for i in range(30))
