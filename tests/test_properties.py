"""Property tests from the survey's strategy: spatial join = brute force, anti join completes
the known ids, scores stay in range; plus the streaming ingest and the source catalogue."""

import csv
import json
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parcelspark.operators import geocode, spatial, summary
from parcelspark.operators.sales import RAW_SALES_COLUMNS


def _inside(px, py, ring):
    """Boundary-inclusive even-odd test in plain Python."""
    n = len(ring)
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1) == 0 and min(x1, x2) <= px <= max(x1, x2) \
                and min(y1, y2) <= py <= max(y1, y2):
            return True
    odd = False
    for i in range(n):
        (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
        if (y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def _polygon(rng, cx, cy):
    # star-shaped polygon with vertices on a 1/16 grid (exact binary fractions)
    pts = []
    for k in range(rng.randint(3, 9)):
        import math
        a = 2 * math.pi * k / 9 + rng.random() * 0.5
        r = rng.randint(2, 16) / 16
        pts.append([round((cx + r * math.cos(a)) * 16) / 16, round((cy + r * math.sin(a)) * 16) / 16])
    return pts


@settings(max_examples=3, deadline=None)
@given(st.integers(min_value=0, max_value=10_000))
def test_point_in_polygon_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    polys = [_polygon(rng, rng.randint(0, 3), rng.randint(0, 3)) for _ in range(6)]
    feats = spark.createDataFrame(
        [(i, {"type": "Polygon", "coordinates": str([p + [p[0]]])}) for i, p in enumerate(polys)],
        "fid int, geometry struct<type: string, coordinates: string>")
    pts = [(j, rng.randint(-16, 64) / 16, rng.randint(-16, 64) / 16) for j in range(300)]
    pts += [(300 + j, p[0][0], p[0][1]) for j, p in enumerate(polys)]          # vertices
    df = spark.createDataFrame(pts, "pid int, x double, y double")
    got = {r["pid"]: r["hit"] for r in spatial.attach_points(
        df, feats, x="x", y="y", feature_id="fid", order="fid", mapping={"fid": "hit"}, cell=0.5).collect()}
    for pid, x, y in pts:
        expected = next((i for i, p in enumerate(polys) if _inside(x, y, p)), None)
        assert got[pid] == expected, (pid, x, y)


def test_missing_ids_complete_the_known_set(spark):
    wanted = spark.createDataFrame([(str(i),) for i in range(50)] + [("",), (None,)], "parcel_id string")
    links = spark.createDataFrame([(str(i), "a" if i % 2 else "") for i in range(0, 80, 3)], "idu string, id_adr string")
    missing = {r["idu"] for r in geocode.missing_link_ids(wanted, links).collect()}
    known = {r["idu"] for r in links.collect()}
    assert missing | (known & {str(i) for i in range(50)}) == {str(i) for i in range(50)}
    assert not missing & known


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 5), st.floats(0, 5), st.floats(0, 100)), min_size=1, max_size=20))
def test_quality_score_in_range(spark, rows):
    df = spark.createDataFrame(rows, "noise_score double, air_score double, high_noise_share_pct double")
    out = summary.environment_indices(df).agg(F.min("quality_of_life_score"), F.max("quality_of_life_score"),
                                              F.min("environmental_pressure_index"),
                                              F.max("environmental_pressure_index")).first()
    assert 0 <= out[0] <= out[1] <= 10 and 0 <= out[2] <= out[3] <= 100


def test_streaming_ingest(spark, tmp_path):
    from parcelspark.streaming.ingest import start_sales_ingest
    bronze = tmp_path / "bronze"
    bronze.mkdir()
    row = {c: "" for c in RAW_SALES_COLUMNS}
    row.update({"Nature mutation": "Vente", "Valeur fonciere": "300000", "Code postal": "75001",
                "Code departement": "75", "Code commune": "101", "Type local": "Maison",
                "Surface reelle bati": "60", "No voie": "3", "Voie": "RUE A"})
    for name, rows in [("valeursfoncieres-2023-paris.csv", [row, row]), ("valeursfoncieres-2024-paris.csv", [row]),
                       ("notes.csv", [row])]:
        with open(bronze / name, "w", newline="", encoding="utf-8") as fh:
            w = csv.writer(fh)
            w.writerow(RAW_SALES_COLUMNS)
            for r in rows:
                w.writerow([r[c] for c in RAW_SALES_COLUMNS])
    q = start_sales_ingest(spark, str(bronze), str(tmp_path / "silver"), str(tmp_path / "ckpt"), trigger_once=True)
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "silver"))
    counts = {r["year"]: r["count"] for r in out.groupBy("year").count().collect()}
    assert counts == {2023: 2, 2024: 1}


def test_source_catalogue(spark, tmp_path):
    from parcelspark.sources.catalogue import list_sources, load_sources
    y = tmp_path / "sources.yaml"
    y.write_text("sources:\n  sales_2024:\n    label: Sales 2024\n    group: open data\n    kind: sales_zip\n"
                 "    url: file:///x\n    target_dir: data/raw\n    target_file: s.zip\n    summary: s\n"
                 "    filtered_file: s-city.csv\n    department_code: '75'\n    delimiter: '|'\n"
                 "  rents:\n    label: Rents\n    group: city\n    kind: file\n    url: file:///y\n"
                 "    target_dir: data/raw\n    target_file: r.csv\n    summary: r\n", encoding="utf-8")
    rows = {r["name"]: r for r in list_sources(load_sources(spark, str(y))).collect()}
    assert rows["sales_2024"]["filtered_path"] == "data/raw/s-city.csv"
    assert rows["rents"]["filtered_path"] is None and rows["rents"]["target_path"] == "data/raw/r.csv"


def test_overlay_leaves_and_reenters_concave_polygon(spark):
    from parcelspark.operators.overlay import clip_lines
    # U shape: [0,3]x[0,3] minus the notch [1,2]x[1,3]; a horizontal line at y=2 crosses the notch
    u = [[0, 0], [3, 0], [3, 3], [2, 3], [2, 1], [1, 1], [1, 3], [0, 3], [0, 0]]
    polys = spark.createDataFrame([(1, {"type": "Polygon", "coordinates": str([u])})],
                                  "fid int, geometry struct<type: string, coordinates: string>")
    lines = spark.createDataFrame([
        (10, {"type": "LineString", "coordinates": "[[-1, 2], [4, 2]]"}),          # two parts
        (11, {"type": "LineString", "coordinates": "[[1, 1], [1, 2.5], [1, 3]]"}),  # along the notch edge
        (12, {"type": "LineString", "coordinates": "[[3, 3], [4, 4]]"}),            # touches a vertex only
        (13, {"type": "MultiLineString", "coordinates": "[[[0.5, -1], [0.5, 0.5]], [[2.5, 0.5], [2.5, 5]]]"})],
        "lid int, geometry struct<type: string, coordinates: string>")
    out = {r["lid"]: r for r in clip_lines(lines, polys, line_id="lid", feature_id="fid", cell=0.5).collect()}
    assert set(out) == {10, 11, 13}
    assert out[10]["parts"] == 2 and abs(out[10]["length"] - 2.0) < 1e-12
    import json
    assert json.loads(out[10]["geometry"]["coordinates"]) == [[[0.0, 2.0], [1.0, 2.0]], [[2.0, 2.0], [3.0, 2.0]]]
    assert out[11]["parts"] == 1 and abs(out[11]["length"] - 2.0) < 1e-12      # boundary counts, vertices kept
    assert json.loads(out[11]["geometry"]["coordinates"]) == [[1.0, 1.0], [1.0, 2.5], [1.0, 3.0]]
    assert out[13]["parts"] == 2 and abs(out[13]["length"] - 3.0) < 1e-12      # 0.5 + 2.5


def test_metric_block_invariant_to_order_and_partitions(spark):
    from parcelspark.operators.metrics import sales_metrics
    from parcelspark.plans.queries import cleaned_sales
    base = cleaned_sales(spark, "/root/testdata/sf0.001")
    a = sales_metrics(base, ["arrondissement", "year"], apartment="STANDARD", house="ECONOMY")
    b = sales_metrics(base.repartition(13, "transaction_id").orderBy(F.rand(5)), ["arrondissement", "year"],
                      apartment="STANDARD", house="ECONOMY")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_missing_link_table_reads_empty(spark, tmp_path):
    from parcelspark.sources.readers import read_links
    from parcelspark.sinks.writers import write_links_versioned
    empty = read_links(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "id_adr" in empty.columns
    first = spark.createDataFrame([("p1", "a", "GEO", "1", "1", 1)], empty.schema)
    write_links_versioned(first, str(tmp_path / "links"))
    import time
    time.sleep(0.01)
    second = geocode.merge_links(read_links(spark, str(tmp_path / "links")),
                                 spark.createDataFrame([("p2", "b", None, "2", "1", 1)], empty.schema))
    write_links_versioned(second, str(tmp_path / "links"))
    assert sorted(r["idu"] for r in read_links(spark, str(tmp_path / "links")).collect()) == ["p1", "p2"]
    time.sleep(0.01)
    # a second batch merges into the merged table: its row replaces the stored one, the order goes on
    third = geocode.merge_links(read_links(spark, str(tmp_path / "links")), spark.createDataFrame(
        [("p1", "a", "GEO", "9", "9", 0), (None, None, None, "0", "0", 1), (None, None, None, "5", "5", 2)], empty.schema))
    write_links_versioned(third, str(tmp_path / "links"))
    rows = {r["idu"]: r for r in read_links(spark, str(tmp_path / "links")).collect()}
    assert set(rows) == {"p1", "p2", None} and rows["p1"]["nb_adr"] == "9" and rows[None]["nb_adr"] == "5"
    assert rows["p2"]["seq"] < rows["p1"]["seq"] < rows[None]["seq"]
    # files of a version that was never committed stay unseen
    first.write.parquet(str(tmp_path / "links" / "version=99999999999999"))
    assert read_links(spark, str(tmp_path / "links")).count() == 3
    assert geocode.best_links(read_links(spark, str(tmp_path / "links"))).where("idu IS NULL").count() == 0


def _sales_file(path, rows, columns):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(columns)] + [",".join(r[c] for c in columns) for r in rows]) + "\n", encoding="utf-8")


def test_sales_files_by_name_and_year_of_the_right_string(spark, tmp_path):
    from parcelspark.operators.sales import RAW_SALES_COLUMNS
    from parcelspark.sources.readers import read_sales
    row = lambda tag: {c: f"{tag} {c}" for c in RAW_SALES_COLUMNS}
    d = tmp_path / "sales"
    _sales_file(d / "valeursfoncieres=2024" / "part-02012-ab.csv", [row("a")], RAW_SALES_COLUMNS)
    _sales_file(d / "valeursfoncieres=2023" / "part-00003-ab2031cd-c000.csv", [row("b")], RAW_SALES_COLUMNS[::-1])
    got = {r["year"]: r for r in read_sales(spark, str(d)).collect()}
    assert set(got) == {2024, 2023}
    for year, tag in ((2024, "a"), (2023, "b")):
        assert all(got[year][c] == f"{tag} {c}" for c in RAW_SALES_COLUMNS)
    e = tmp_path / "yearly"
    _sales_file(e / "valeursfoncieres-2022-paris.csv", [row("c")], ["extra", *RAW_SALES_COLUMNS][1:])
    _sales_file(e / "valeursfoncieres-paris.csv", [row("d")], RAW_SALES_COLUMNS)
    assert [r["year"] for r in read_sales(spark, str(e)).collect()] == [2022]


def test_national_filter_keeps_the_yearly_file_names(spark, tmp_path):
    from parcelspark.operators.sales import RAW_SALES_COLUMNS
    from parcelspark.sources.readers import filter_national_sales, read_sales
    row = {**{c: "x" for c in RAW_SALES_COLUMNS}, "Code departement": "75"}
    _sales_file(tmp_path / "national" / "valeursfoncieres-2021.txt", [row, {**row, "Code departement": "69"}], RAW_SALES_COLUMNS)
    out = filter_national_sales(spark, str(tmp_path / "national"), "75", str(tmp_path / "city"), sep=",", partition_by="source")
    assert [r["year"] for r in read_sales(spark, out).collect()] == [2021]


def test_income_reader_never_opens_the_meta_file(spark, tmp_path):
    from parcelspark.sources.readers import read_income
    d = tmp_path / "income"
    d.mkdir()
    (d / "meta_a.csv").write_text("COD;LIB\n1;2\n", encoding="utf-8")
    (d / "base.CSV").write_text("IRIS;DEC_MED21\n751010101;30000\n", encoding="utf-8")
    got = read_income(spark, str(d))
    assert got.columns == ["IRIS", "DEC_MED21"] and got.count() == 1


def test_unknown_districts_are_errors(spark):
    import pytest as _pytest
    from parcelspark.operators import summary
    ov = spark.createDataFrame([(1, "a", 2024, 5.0)], "arrondissement int, name string, selected_sales_year int, v double")
    for c in summary.COMPARE_METRICS:
        ov = ov.withColumn(c, F.col("v"))
    with _pytest.raises(LookupError):
        summary.compare(ov, 1, 99)
    yearly = spark.createDataFrame([(1, 2024, 3.0)], "arrondissement int, year int, m double")
    with _pytest.raises(LookupError):
        summary.timeline(yearly, yearly, yearly, 99, ov)
    more = yearly.union(spark.createDataFrame([(1, 2022, 1.0), (1, 2023, 2.0)], yearly.schema))
    served = [(r["name"], r["theme"], r["year"]) for r in summary.timeline(more, more, more, 1, ov).collect()]
    assert served == [("a", t, y) for t in ("rents", "sales", "social") for y in (2022, 2023, 2024)]     # served order
    line = summary.compare(ov, 1, 1).first()
    assert (line["left_name"], line["right_name"], line["sales_year"], line["delta"]) == ("a", "a", 2024, 0.0)


def test_checkpoint_folder_is_one_per_session(spark):
    from parcelspark.session import checkpoint_dir
    assert checkpoint_dir(spark) == checkpoint_dir(spark)


def test_cell_exposure_golden(spark):
    sq = lambda x0, y0, x1, y1: str([[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]])
    districts = spark.createDataFrame(
        [(1, {"type": "Polygon", "coordinates": sq(0, 0, 2, 2)}),
         (2, {"type": "Polygon", "coordinates": sq(2, 0, 4, 2)}),
         (3, {"type": "Polygon", "coordinates": sq(10, 10, 11, 11)})],       # no cells
        "arrondissement int, geometry struct<type: string, coordinates: string>")
    cells = spark.createDataFrame([
        (23, 0.0, 0.0, 1.0, 1.0),      # district 1: noise 3, air 2, area 1
        (11, 0.0, 1.0, 1.0, 2.0),      # district 1: noise 1, air 1, area 1
        (32, 1.5, 0.5, 2.5, 1.5),      # centre (2, 1) on the shared border: district 1 wins, area 1
        (13, 3.0, 0.0, 3.0, 2.0),      # zero area: skipped
        (12, 20.0, 20.0, 21.0, 21.0),  # outside every district
        (21, 2.5, 0.0, 3.5, 2.0)],     # district 2: noise 1, air 2, area 2
        "category int, minx double, miny double, maxx double, maxy double")
    out = {r["arrondissement"]: r for r in spatial.cell_exposure(
        cells, districts, feature_id="arrondissement", cell=1.0).collect()}
    d1, d2, d3 = out[1], out[2], out[3]
    assert d1["noise_cell_count"] == 3 and d1["noise_score"] == 2.0          # (3 + 1 + 2) / 3
    assert d1["air_score"] == 2.0 and d1["high_noise_share_pct"] == 33.33    # (2 + 1 + 3) / 3
    assert d2["noise_cell_count"] == 1 and d2["noise_score"] == 1.0 and d2["air_score"] == 2.0
    assert (d3["noise_score"], d3["air_score"], d3["high_noise_share_pct"], d3["noise_cell_count"]) == (0.0, 0.0, 0.0, 0)


def test_point_in_polygon_with_adaptive_cell(spark):
    rng = random.Random(99)
    polys = [_polygon(rng, rng.randint(0, 3), rng.randint(0, 3)) for _ in range(5)]
    feats = spark.createDataFrame(
        [(i, {"type": "Polygon", "coordinates": str([p + [p[0]]])}) for i, p in enumerate(polys)],
        "fid int, geometry struct<type: string, coordinates: string>")
    pts = [(j, rng.randint(-16, 64) / 16, rng.randint(-16, 64) / 16) for j in range(200)]
    df = spark.createDataFrame(pts, "pid int, x double, y double")
    got = {r["pid"]: r["hit"] for r in spatial.attach_points(
        df, feats, x="x", y="y", feature_id="fid", order="fid", mapping={"fid": "hit"}).collect()}
    for pid, x, y in pts:
        assert got[pid] == next((i for i, p in enumerate(polys) if _inside(x, y, p)), None)


def test_one_huge_polygon_among_small_ones(spark):
    # adaptive grid: the big square would span millions of the small squares' tiles
    square = lambda x, y, a: str([[[x, y], [x + a, y], [x + a, y + a], [x, y + a], [x, y]]])
    shapes = [(i, i * 0.01, 0.0, 0.01) for i in range(20)] + [(99, -500.0, -500.0, 1000.0)]
    feats = spark.createDataFrame([(i, {"type": "Polygon", "coordinates": square(x, y, a)}) for i, x, y, a in shapes],
                                  "fid int, geometry struct<type: string, coordinates: string>")
    polys = spatial.polygon_table(feats, "fid", "fid", [])
    assert spatial.polygon_tiles(polys, spatial.suggest_cell(polys)).groupBy("_fid").count().agg(F.max("count")).first()[0] <= 9
    pts = [(0, 0.005, 0.005), (1, 0.155, 0.002), (2, 400.0, -450.0), (3, 600.0, 0.0), (4, None, 1.0)]
    got = {r["pid"]: r["hit"] for r in spatial.attach_points(
        spark.createDataFrame(pts, "pid int, x double, y double"), feats, x="x", y="y", feature_id="fid", order="fid",
        mapping={"fid": "hit"}).collect()}
    assert got == {0: 0, 1: 15, 2: 99, 3: None, 4: None}
    from parcelspark.operators.overlay import clip_lines
    lines = spark.createDataFrame([(7, {"type": "LineString", "coordinates": "[[-499, -499], [0.005, 0.005], [600, 0.005]]"})],
                                  "lid int, geometry struct<type: string, coordinates: string>")
    clipped = {r["fid"]: r["length"] for r in clip_lines(lines, feats, line_id="lid", feature_id="fid").collect()}
    assert set(clipped) == {*range(20), 99}
    assert abs(clipped[99] - (499.005 * 2 ** 0.5 + 499.995)) < 1e-6 and abs(clipped[5] - 0.01) < 1e-9


def _star(n, seed, big=1.0):
    """Coordinates (integers, so that the plain test is exact) of a jagged ring with a jagged hole."""
    import math
    import random
    rng = random.Random(seed)

    def ring(lo, hi, m):
        pts = []
        for i in range(m):
            r = rng.uniform(lo, hi)
            pts.append([round(r * math.cos(2 * math.pi * i / m)), round(r * math.sin(2 * math.pi * i / m))])
        return pts + [pts[0]]

    return [ring(7e5 * big, 1e6 * big, n), ring(1e5 * big, 3e5 * big, max(3, n // 4))]


def _covered(x, y, rings):
    """Plain even-odd rule with the boundary inside, in exact integers."""
    odd = False
    for r in rings:
        for (x1, y1), (x2, y2) in zip(r, r[1:]):
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y):
                left = (x - x1) * (y2 - y1) < (y - y1) * (x2 - x1)
                odd ^= left if y2 > y1 else not left and (x - x1) * (y2 - y1) != (y - y1) * (x2 - x1)
    return odd


def test_polygons_with_many_edges_keep_them_in_bands(spark):
    import random
    rng = random.Random(8)
    comb = [[[x, (x % 2) * 900] for x in range(301)] + [[300, -5], [0, -5], [0, 0]]]           # edges as tall as the polygon
    shapes = {1: _star(900, 1), 2: _star(40, 2, 0.05), 3: comb, 4: _star(12, 3), 5: [[[0, 7], [50, 7], [90, 7], [0, 7]] * 30]}
    feats = spark.createDataFrame([(i, {"type": "Polygon", "coordinates": json.dumps(r)}) for i, r in shapes.items()],
                                  "fid int, geometry struct<type: string, coordinates: string>")
    polys = spatial.polygon_table(feats, "fid", "fid", [])
    assert spatial.layer_shape(polys, 1.0)[1] > spatial.BAND_EDGES
    bands = spatial.edge_bands(polys.where("_fid = 1")).select(F.size("edges").alias("n"))
    assert bands.agg(F.max("n")).first()[0] < 300 and bands.agg(F.sum("n")).first()[0] <= 3 * 1125
    pts = [(rng.randrange(-10 ** 6, 10 ** 6), rng.randrange(-10 ** 6, 10 ** 6)) for _ in range(250)]
    pts += [(rng.randrange(-9, 310), rng.randrange(-9, 910)) for _ in range(120)]
    pts += [tuple(p) for r in shapes.values() for ring in r for p in rng.choices(ring, k=9)]       # vertices
    pts += [(20, 7), (95, 7), (300, 2), (0, 0)]
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "pid int, x double, y double")
    for only in ([1, 2, 3, 4, 5], [3, 5], [1], [5]):
        got = {r["pid"]: r["hit"] for r in spatial.attach_points(df, feats.where(F.col("fid").isin(only)), x="x", y="y", feature_id="fid",
                                                                 order="fid", mapping={"fid": "hit"}).collect()}
        for i, (x, y) in enumerate(pts):
            assert got[i] == next((k for k in only if _covered(x, y, shapes[k])), None), (only, x, y)


def test_a_point_costs_a_band_not_the_polygon(spark):
    feats = spark.createDataFrame([(1, {"type": "Polygon", "coordinates": json.dumps(_star(100_000, 4))})],
                                  "fid int, geometry struct<type: string, coordinates: string>")
    polys = spatial.polygon_table(feats, "fid", "fid", []).cache()
    assert polys.select(F.size("edges")).first()[0] > 100_000
    bands = spatial.edge_bands(polys).cache()
    # edges met by points all over the polygon: those of their bands on each level
    df = spark.range(500).select((F.rand(1) * 2e6 - 1e6).alias("_x"), (F.rand(2) * 2e6 - 1e6).alias("_y"), F.lit(1).alias("_fid"))
    heads = polys.select("_fid", F.col("miny").alias("bottom"),
                         ((F.col("maxy") - F.col("miny")) / spatial.band_count(F.size("edges"))).alias("height"))
    asked = df.join(heads, "_fid").withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(20)]))) \
        .withColumn("band", spatial.band_of(F.col("_y"), "bottom", "height", "level"))
    met = asked.join(bands, ["_fid", "level", "band"]).groupBy("_x", "_y").agg(F.sum(F.size("edges")).alias("n"))
    mean = met.agg(F.avg("n")).first()[0]
    assert mean < 0.25 * 125_000
    assert spatial.banded_hits(df, polys).count() > 100


def test_link_batches_without_an_order(spark, tmp_path):
    from parcelspark.sources.readers import commit_list, read_links
    from parcelspark.sinks.writers import write_links_versioned
    schema = "idu string, id_adr string, type_lien string, nb_adr string, nb_parc string"
    stored = spark.createDataFrame([("p", "a", "GEO", "1", "1", 0), ("r", "c", None, "5", "1", 1), ("s", "d", None, "7", "1", None)], schema + ", seq long")
    batch = [("p", "a", "GEO", "2", "9"), ("q", "b", "BAN", "3", "1"), ("q", "b", "BAN", "3", "0")]
    merged = geocode.merge_links(stored, spark.createDataFrame(batch, schema))
    rows = {r["idu"]: (r["nb_adr"], r["nb_parc"]) for r in merged.collect()}
    assert rows == {"p": ("2", "9"), "q": ("3", "1"), "r": ("5", "1"), "s": ("7", "1")}
    assert merged.where("seq IS NULL").count() == 0
    mixed = spark.createDataFrame([(*batch[0], None), ("p", "a", "GEO", "4", "4", 0)], schema + ", seq long")
    assert {r["nb_adr"] for r in geocode.merge_links(stored, mixed).where("idu = 'p'").collect()} == {"4"}
    # versions whose list is lost are not taken for an empty table
    base = str(tmp_path / "links")
    write_links_versioned(merged, base)
    assert read_links(spark, base).count() == 4
    import os
    os.rename(commit_list(base), str(tmp_path / "elsewhere"))
    with pytest.raises(FileNotFoundError):
        read_links(spark, base)


def test_histograms_of_years_add_up(spark, tmp_path):
    from parcelspark.operators import metrics
    from parcelspark.operators.histogram import group_metrics, write_histogram
    from parcelspark.plans import queries as q
    from parcelspark.operators import quantile
    base = q.micro_sales(spark, "/root/testdata/sf0.001").withColumn("quartier_id", F.col("supplier_id")) \
        .withColumn("quartier_name", F.lit("n")).withColumn("iris_code", F.when(F.col("rooms") > 9, "x")) \
        .withColumn("iris_name", F.lit("n")).withColumn("iris_type", F.lit("t")).cache()
    years = sorted(r[0] for r in base.select("year").distinct().collect())
    whole = write_histogram(metrics.market_histogram(base), str(tmp_path / "whole"))
    parts = str(tmp_path / "parts")
    for y in [*years, years[0]]:                             # one year twice: it replaces its own rows only
        write_histogram(metrics.market_histogram(base.where(F.col("year") == y)), parts)
    for grain in metrics.MARKET_GRAINS:
        tables = [sorted(map(str, metrics.market_table(spark.read.parquet(p), grain, **q.KINDS).collect())) for p in (whole, parts)]
        assert tables[0] == tables[1] and tables[0]
    direct = sorted(map(str, metrics.street_sales_metrics(base, **q.KINDS).collect()))
    assert direct == sorted(map(str, metrics.market_table(spark.read.parquet(parts), "street", **q.KINDS).collect()))
    assert {r["year"] for r in spark.read.parquet(parts).select("year").distinct().collect()} == set(years)
    # NULL keys count at no grain that has them
    assert spark.read.parquet(whole).where("grain = 'iris' AND iris_code IS NULL").count() == 0
    hist = spark.read.parquet(whole)
    usual = sorted(map(str, metrics.market_table(hist, "arrondissement", **q.KINDS).collect()))
    before, quantile.HOT_GROUP_ROWS = quantile.HOT_GROUP_ROWS, 20
    try:
        assert sorted(map(str, metrics.market_table(hist, "arrondissement", **q.KINDS).collect())) == usual
    finally:
        quantile.HOT_GROUP_ROWS = before
