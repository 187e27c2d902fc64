"""End-to-end build on tiny hand-made Bronze files (domain goldens worked out by hand)."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from parcelspark.operators.sales import RAW_SALES_COLUMNS
from parcelspark.plans.build import CATALOGUE_INPUTS, BronzeInputs, bronze_from_catalogue, build
from parcelspark.sinks.writers import write_links_versioned


def _sale(**kv):
    row = {c: "" for c in RAW_SALES_COLUMNS}
    row.update({"Date mutation": "01/02/2024", "Nature mutation": "Vente", "Code departement": "75",
                "Code commune": "101", "Code postal": "75001", "Type local": "Appartement",
                "Surface reelle bati": "50", "Nombre pieces principales": "2", "Section": "",
                "No plan": ""})
    row.update(kv)
    return row


def _csv(path, rows, cols, sep):
    with open(path, "w", encoding="utf-8-sig", newline="") as fh:
        w = csv.writer(fh, delimiter=sep)
        w.writerow(cols)
        for r in rows:
            w.writerow([r.get(c, "") for c in cols])


def _square(x0, y0, x1, y1):
    return [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]


def _fc(features):
    return {"type": "FeatureCollection", "features": features}


@pytest.fixture(scope="module")
def bronze_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("bronze")


@pytest.fixture(scope="module")
def built(spark, bronze_folder):
    d = bronze_folder
    (d / "sales").mkdir()
    opera = {"No voie": "0012", "B/T/Q": "B", "Type de voie": "AV", "Voie": "DE L'OPÉRA"}
    sales = [
        _sale(**opera, **{"Valeur fonciere": "250000,00"}),                      # tier 1
        _sale(**opera, **{"Valeur fonciere": "250000,00"}),                      # duplicate
        _sale(**opera, **{"Valeur fonciere": "250000,00", "Nature mutation": "Echange"}),
        _sale(**opera, **{"Valeur fonciere": "abc"}),
        _sale(**{"No voie": "20", "B/T/Q": "T", "Type de voie": "AV", "Voie": "DE L'OPÉRA",
                 "Valeur fonciere": "300000"}),                                   # tier 2
        _sale(**{"No voie": "99", "Voie": "RUE X", "Section": "cd", "No plan": "5",
                 "Valeur fonciere": "310000"}),                                   # tier 3, GEO link
        _sale(**{"No voie": "98", "Voie": "RUE X", "Section": "cd", "No plan": "6",
                 "Valeur fonciere": "320000"}),                                   # link to unknown id
        _sale(**{"No voie": "97", "Voie": "RUE X", "Section": "cd", "No plan": "7",
                 "Valeur fonciere": "330000"}),                                   # no link yet
        _sale(**{"No voie": "5", "Voie": "RUE Y", "Code postal": "75116", "Type local": "Maison",
                 "Valeur fonciere": "1 250 000,50", "Surface reelle bati": "125"}),
        _sale(**opera, **{"Valeur fonciere": "250000", "Type local": "Dépendance"}),
        _sale(**opera, **{"Valeur fonciere": "250000", "Surface reelle bati": "10"}),
        _sale(**opera, **{"Valeur fonciere": "10000", "Surface reelle bati": "11"}),
        _sale(**opera, **{"Valeur fonciere": "250000", "Code postal": "69001"}),
    ]
    _csv(d / "sales" / "valeursfoncieres-2024-paris.csv", sales, RAW_SALES_COLUMNS, ",")
    _csv(d / "sales" / "valeursfoncieres-paris.csv", sales[:1], RAW_SALES_COLUMNS, ",")  # no year

    acols = ["cle_interop", "commune_insee", "voie_nom", "numero", "suffixe", "long", "lat",
             "certification_commune"]
    _csv(d / "adresses.csv", [
        {"cle_interop": "a1", "commune_insee": "75101", "voie_nom": "Avenue de l'Opéra", "numero": "12",
         "suffixe": "bis", "long": "2.305", "lat": "48.865", "certification_commune": "1"},
        {"cle_interop": "a0", "commune_insee": "75101", "voie_nom": "AV DE L OPERA", "numero": "12",
         "suffixe": "B", "long": "2.315", "lat": "48.865", "certification_commune": "2"},
        {"cle_interop": "a2", "commune_insee": "75101", "voie_nom": "Avenue de l'Opéra", "numero": "20",
         "suffixe": "", "long": "2.34", "lat": "48.86", "certification_commune": ""},
        {"cle_interop": "a3", "commune_insee": "75116", "voie_nom": "Rue Z", "numero": "1",
         "suffixe": "", "long": "2.35", "lat": "48.86", "certification_commune": "1"},
        {"cle_interop": "a4", "commune_insee": "75101", "voie_nom": "Rue Z", "numero": "2",
         "suffixe": "", "long": "", "lat": "48.86", "certification_commune": "1"},
        {"cle_interop": "a5", "commune_insee": "92004", "voie_nom": "Rue Z", "numero": "3",
         "suffixe": "", "long": "2.35", "lat": "48.86", "certification_commune": "1"},
    ], acols, ";")

    links = spark.createDataFrame([
        ("75101000CD0005", "a3", "GEO", "1", "1", 1), ("75101000CD0005", "a1", "BAN", "1", "1", 2),
        ("75101000CD0006", "zz", "BAN", "2", "1", 3), ("75101000CD0008", "", "", "", "", 4)],
        "idu string, id_adr string, type_lien string, nb_adr string, nb_parc string, seq long")
    write_links_versioned(links, str(d / "links"))

    d1, d16 = _square(2.30, 48.85, 2.34, 48.87), _square(2.34, 48.85, 2.38, 48.87)
    (d / "districts.geojson").write_text(json.dumps(_fc([
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [d1]},
         "properties": {"c_ar": 1, "c_arinsee": 75101, "l_aroff": "Louvre", "l_ar": "1er", "surface": 1.234,
                        "perimetre": 5.0}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[d16]]},
         "properties": {"c_ar": 16, "c_arinsee": 75116, "l_aroff": "Passy", "l_ar": "16e", "surface": 2.0,
                        "perimetre": 6.0}}])))
    hole = _square(2.31, 48.855, 2.32, 48.86)[::-1]
    (d / "quarters.geojson").write_text(json.dumps(_fc([
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [d1, hole]},
         "properties": {"c_quinsee": "7510101", "c_qu": 1, "c_ar": 1, "l_qu": "Q1", "surface": 1.0,
                        "perimetre": 1.0}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [d16]},
         "properties": {"c_quinsee": "7511661", "c_qu": 61, "c_ar": 16, "l_qu": "Q61", "surface": 1.0,
                        "perimetre": 1.0}}])))
    line = lambda coords, **p: {"type": "Feature", "geometry": {"type": "LineString", "coordinates": coords},
                                "properties": p}
    (d / "streets.geojson").write_text(json.dumps(_fc([
        line([[2.32, 48.86], [2.36, 48.86]], c_desi="AV", c_liaison="DE L'", l_voie="OPÉRA", n_sq_vo="11"),
        line([[2.34, 48.851], [2.34, 48.869]], c_desi="RUE", l_voie="DE LA LIMITE", n_sq_vo="12"),
        line([[2.38, 48.87], [2.40, 48.89]], c_desi="RUE", l_voie="DU COIN", n_sq_vo="13"),
        line([[2.31, 48.86], [2.33, 48.86]], c_desi="", l_voie="", n_sq_vo="14")])))

    shape = json.dumps({"type": "Polygon", "coordinates": [d1]}).replace('"', '""')
    with open(d / "iris.csv", "w", encoding="utf-8") as fh:
        fh.write("CODE_IRIS;NOM_IRIS;TYP_IRIS;DEP;INSEE_COM;Geo Shape\n")
        fh.write(f'751010101;Iris A;H;75;75101;"{shape}"\n')
        fh.write(f'920040101;Iris B;H;92;92004;"{shape}"\n')
    (d / "income").mkdir()
    _csv(d / "income" / "filosofi.csv", [
        {"IRIS": "751010101", "DEC_MED21": "30 000,5", "DEC_TP6021": "10,0", "DEC_Q121": "20000",
         "DEC_Q321": "40000", "DEC_PIMP21": "60"},
        {"IRIS": "751010102", "DEC_MED21": "40000", "DEC_TP6021": "ns", "DEC_Q121": "25000",
         "DEC_Q321": "50000", "DEC_PIMP21": "70"},
        {"IRIS": "920040101", "DEC_MED21": "1", "DEC_TP6021": "1", "DEC_Q121": "1", "DEC_Q321": "1",
         "DEC_PIMP21": "1"}], ["IRIS", "DEC_MED21", "DEC_TP6021", "DEC_Q121", "DEC_Q321", "DEC_PIMP21"], ";")
    _csv(d / "income" / "meta_filosofi.csv", [{"IRIS": "751019999", "DEC_MED21": "999999"}],
         ["IRIS", "DEC_MED21", "DEC_TP6021", "DEC_Q121", "DEC_Q321", "DEC_PIMP21"], ";")
    rcols = ["Année", "Loyers de référence", "Loyers de référence majorés", "Loyers de référence minorés",
             "Numéro INSEE du quartier"]
    _csv(d / "rents.csv", [
        {"Année": "2024", "Loyers de référence": "30,5", "Loyers de référence majorés": "36,6",
         "Loyers de référence minorés": "21,35", "Numéro INSEE du quartier": "7510101"},
        {"Année": "2024", "Loyers de référence": "20", "Loyers de référence majorés": "24",
         "Loyers de référence minorés": "14", "Numéro INSEE du quartier": "511661"},
        {"Année": "2024", "Loyers de référence": "99", "Loyers de référence majorés": "99",
         "Loyers de référence minorés": "99", "Numéro INSEE du quartier": ""}], rcols, ";")
    scols = ["Arrondissement", "Année du financement - agrément", "Nombre total de logements financés",
             "Dont nombre de logements PLA I", "Dont nombre de logements PLUS", "Dont nombre de logements PLS",
             "Identifiant livraison"]
    _csv(d / "social.csv", [
        {"Arrondissement": "1", "Année du financement - agrément": "2024", "Nombre total de logements financés": "10",
         "Dont nombre de logements PLA I": "3", "Identifiant livraison": "p1"},
        {"Arrondissement": "1", "Année du financement - agrément": "2024", "Nombre total de logements financés": "5",
         "Identifiant livraison": "p1"},
        {"Arrondissement": "21", "Année du financement - agrément": "2024", "Nombre total de logements financés": "7",
         "Identifiant livraison": "p9"},
        {"Arrondissement": "16", "Année du financement - agrément": "", "Nombre total de logements financés": "7",
         "Identifiant livraison": "p8"}], scols, ";")

    # two equal cells around a point of district 1 (air 2, noise 3 and air 1, noise 1); none in district 16
    from parcelspark.functions.geo import lambert93
    x, y = lambert93("lon", "lat")
    at = spark.createDataFrame([(2.32, 48.864)], "lon double, lat double").select(x.alias("x"), y.alias("y")).first()
    spark.createDataFrame([(c, at["x"] - 5.0, at["y"] - 5.0, at["x"] + 5.0, at["y"] + 5.0) for c in (23, 11)],
                          "category int, minx double, miny double, maxx double, maxy double").write.parquet(str(d / "cells"))

    bronze = BronzeInputs(
        sales=str(d / "sales"), addresses=str(d / "adresses.csv"), links=str(d / "links"),
        iris=str(d / "iris.csv"), income=str(d / "income"), rents=str(d / "rents.csv"),
        social=str(d / "social.csv"), districts=str(d / "districts.geojson"),
        quarters=str(d / "quarters.geojson"), streets=str(d / "streets.geojson"), cells=str(d / "cells"))
    out = build(spark, bronze, str(d / "silver"), str(d / "gold"), csv_copies=True)
    return spark, d, out


def test_silver_sales_filters(built):
    spark, d, _ = built
    tx = spark.read.parquet(str(d / "silver" / "sales_transactions"))
    assert tx.count() == 7          # 13 rows, 6 dropped by the filters; the no-year file skipped
    assert tx.where(F.col("arrondissement") == 16).first()["sale_value_eur"] == 1250000.5


def test_stored_geocoded_sales_have_their_columns(built):
    from parcelspark.operators.sales import GEOCODED_COLUMNS
    spark, d, out = built
    for path in (str(d / "silver" / "sales_geocoded"), out["sales_geocoded"]):
        assert sorted(spark.read.parquet(path).columns) == sorted(GEOCODED_COLUMNS.values())
    assert len(GEOCODED_COLUMNS) == 27


def test_silver_holds_every_table(built):
    spark, d, _ = built
    for name in ("sales_yearly", "sales_quartier_yearly", "sales_iris_yearly", "sales_street_yearly",
                 "sales_building_yearly", "income", "rents_yearly", "social_yearly", "noise"):
        assert spark.read.parquet(str(d / "silver" / name)).columns


def test_district_layer_has_its_perimeter(built):
    spark, d, out = built
    feats = [json.loads(r["value"])["properties"] for r in spark.read.text(out["districts_geojson"]).collect()]
    assert {f["arrondissement"]: f["perimeter_m"] for f in feats} == {1: 5.0, 16: 6.0}


def test_geocode_tiers(built):
    spark, d, _ = built
    geo = {r["house_number"]: r for r in spark.read.parquet(str(d / "silver" / "sales_geocoded")).collect()}
    assert geo["12"]["matched_cle_interop"] == "a0" and geo["12"]["geocode_source"] == "adresses-ban"
    assert abs(geo["12"]["longitude"] - 2.31) < 1e-12            # median of the two rows
    assert geo["20"]["matched_cle_interop"] == "a2"                # key without suffix
    assert geo["99"]["matched_cle_interop"] == "a3" and geo["99"]["geocode_source"] == "ban-plus"
    r98 = geo["98"]                                                # id kept without coordinates
    assert r98["matched_cle_interop"] == "zz" and r98["longitude"] is None and r98["geocode_source"] is None
    assert r98["building_id"] == "zz" and r98["building_id_source"] == "ban_address"
    assert geo["97"]["building_id_source"] == "parcel" and geo["97"]["building_id"] == "75101000CD0007"
    assert geo["5"]["building_id_source"] == "address_key"


def test_point_in_polygon_rules(built):
    spark, d, _ = built
    geo = {r["house_number"]: r for r in spark.read.parquet(str(d / "silver" / "sales_geocoded")).collect()}
    assert geo["12"]["quartier_id"] == "7510101"                  # inside, outside the hole
    assert geo["20"]["quartier_id"] == "7510101"                  # on the shared edge: lowest id wins
    assert geo["99"]["quartier_id"] == "7511661"
    assert geo["98"]["quartier_id"] is None                       # no coordinates
    assert geo["12"]["iris_code"] == "751010101"


def test_links_to_fetch(built):
    spark, d, out = built
    ids = {r["idu"] for r in spark.read.parquet(out["links_to_fetch"]).collect()}
    assert ids == {"75101000CD0007"}


def test_street_overlay(built):
    spark, d, _ = built
    streets = spark.read.text(str(d / "gold" / "streets.geojsonl"))
    feats = [json.loads(r["value"]) for r in streets.collect()]
    keys = sorted(f["properties"]["street_key"] for f in feats)
    assert keys == ["75101|AVENUE DE L OPERA", "75101|RUE DE LA LIMITE",
                    "75116|AVENUE DE L OPERA", "75116|RUE DE LA LIMITE"]
    opera1 = [f for f in feats if f["properties"]["street_key"] == "75101|AVENUE DE L OPERA"][0]
    assert opera1["geometry"]["coordinates"] == [[2.32, 48.86], [2.34, 48.86]]


def test_summary_and_themes(built):
    spark, d, out = built
    s = {r["arrondissement"]: r for r in spark.read.parquet(out["summary"]).collect()}
    assert set(s) == {1, 16}
    assert s[1]["iris_count"] == 2 and s[1]["median_income_eur"] == 35000.25
    assert s[1]["poverty_rate_pct"] == 10.0
    assert s[16]["median_income_eur"] == 35000.25                 # filled with the column median
    assert s[1]["program_count"] == 1 and s[1]["social_units_financed"] == 15.0
    assert s[16]["social_units_financed"] == 0 and s[16]["program_count"] == 0
    assert s[16]["reference_rent_eur_m2"] == 20.0 and s[1]["reference_rent_eur_m2"] == 30.5
    assert s[1]["noise_score"] == 2.0 and s[1]["air_score"] == 1.5 and s[1]["high_noise_share_pct"] == 50.0
    assert s[1]["environmental_pressure_index"] == 40.0 and s[1]["quality_of_life_score"] == 5.9
    assert s[16]["noise_cell_count"] == 0 and s[16]["noise_score"] == 0.0
    assert s[1]["sales_year"] == 2024 and s[1]["year_rent"] == 2024
    assert s[1]["transactions"] == 5 and s[16]["transactions"] == 1


def test_dashboard_document(built):
    spark, d, out = built
    doc = spark.read.json(out["dashboard"]).first()
    assert doc["latest_sales_year"] == 2024 and len(doc["arrondissements"]) == 2
    assert doc["coverage"]["input_rows"] == 7 and doc["coverage"]["ban_plus_rows"] == 1


def test_csv_copies(built):
    spark, d, out = built
    csv_rows = spark.read.option("header", True).csv(out["summary"] + "_csv").count()
    assert csv_rows == spark.read.parquet(out["summary"]).count() == 2


def test_served_reads_validate_and_answer(built):
    from parcelspark.operators import serving, summary
    spark, d, out = built
    yearly = spark.read.parquet(out["sales_yearly"])
    summ = spark.read.parquet(out["summary"])
    quarters = spark.read.parquet(out["sales_quartier_yearly"])
    feats = spark.read.text(out["quarters_geojson"])
    with pytest.raises(LookupError):
        summary.overview(summ, yearly, 1990)
    with pytest.raises(ValueError):
        serving.validate("median_income_eur", "quartier")
    with pytest.raises(LookupError):
        serving.validate("median_price_m2", "region")
    with pytest.raises(LookupError):
        serving.validate("no_such_metric", "arrondissement")
    ov = summary.overview(summ, yearly)
    assert [r["arrondissement"] for r in ov.collect()] == [1, 16]
    assert {r["arrondissement"]: r["rank_by_price"] for r in ov.collect()}[16] is not None
    qfeats = serving.reference_layer(spark, str(d / "gold"), "quartier").select(
        F.col("properties")["quartier_id"].alias("quartier_id"),
        F.col("properties")["arrondissement"].cast("int").alias("arrondissement"), "geometry")
    layer = serving.map_layer("quartier", "transactions", features=qfeats, yearly=quarters).collect()
    assert {r["quartier_id"]: r["metric_value"] for r in layer} == {"7510101": 2.0, "7511661": 1.0}
    stops = serving.legend_stops(ov.withColumn("metric_value", F.col("median_price_m2"))).first()
    assert stops["stop_low"] <= stops["stop_mid"] <= stops["stop_high"]


def _catalogue(path, folder, files, sales_text):
    entry = lambda name, **kv: f"  {name}:\n" + "".join(f"    {k}: '{v}'\n" for k, v in {
        "label": name, "group": "g", "kind": "file", "url": "none", "target_dir": folder, "summary": "s", **kv}.items())
    path.write_text("sources:\n" + "".join(entry(CATALOGUE_INPUTS[role], target_file=f) for role, f in files.items())
                    + entry("sales_2024", target_file=f"{sales_text}.zip", filtered_file="filtered-2024.csv",
                            department_code="75", delimiter="|"), encoding="utf-8")
    return str(path)


def test_build_inputs_from_the_catalogue_alone(built, tmp_path):
    from parcelspark.sources.catalogue import load_sources
    from parcelspark.sources.readers import read_sales
    spark, d, _ = built
    files = {"addresses": "adresses.csv", "iris": "iris.csv", "income": "income.zip", "rents": "rents.csv", "social": "social.csv",
             "districts": "districts.geojson", "quarters": "quarters.geojson", "streets": "streets.geojson"}
    with open(d / "sales" / "valeursfoncieres-2024-paris.csv", encoding="utf-8-sig", newline="") as fh:
        rows = list(csv.DictReader(fh))
    other = dict(rows[0], **{"Code departement": "69"})
    _csv(d / "national-2024.txt", rows + [other], RAW_SALES_COLUMNS, "|")
    links = str(d / "links")

    with pytest.raises(FileNotFoundError, match="gone.csv.*lost-2024.txt"):
        bad = _catalogue(tmp_path / "bad.yaml", str(d), {**files, "rents": "gone.csv"}, "lost-2024.txt")
        bronze_from_catalogue(spark, load_sources(spark, bad), links)
    with pytest.raises(FileNotFoundError, match="no entry"):
        bronze_from_catalogue(spark, load_sources(spark, bad), links, inputs={"streets": "unknown"})

    good = load_sources(spark, _catalogue(tmp_path / "good.yaml", str(d), files, "national-2024.txt"))
    for _ in range(2):                                  # the second time the filtered file is there already
        bronze = bronze_from_catalogue(spark, good, links, cells=str(d / "cells"))
        assert bronze == BronzeInputs(
            sales=[str(d / "filtered-2024.csv")], links=links, cells=str(d / "cells"),
            **{role: str(d / f).removesuffix(".zip") for role, f in files.items()})
    kept = read_sales(spark, bronze.sales)
    assert sorted(map(str, kept.collect())) == sorted(map(str, read_sales(spark, str(d / "sales")).collect()))


def test_ordered_tables_keep_their_order_over_files(spark, tmp_path):
    from parcelspark.sinks.writers import write_table
    from parcelspark.sources.readers import read_in_order
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).cast("int").alias("year"), F.lit("x" * 50).alias("v"))
    df = df.withColumn("k", F.when(F.col("k") > 0, F.col("k"))).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "300")
    try:
        whole = write_table(df, str(tmp_path / "whole"), order=["k"])
        years = write_table(df, str(tmp_path / "years"), partition_by="year", order=["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(list((tmp_path / "whole").glob("part-*"))) > 10
    expected = sorted(df.select("k").collect(), key=lambda r: (r["k"] is not None, r["k"]))
    got = sorted(read_in_order(spark, whole).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(1, 5001)) and [r["k"] for r in got] == [r["k"] for r in expected]
    rows = sorted(read_in_order(spark, years).collect(), key=lambda r: r["position"])
    assert [(r["year"], r["k"] or 0) for r in rows] == sorted((r["year"], r["k"] or 0) for r in rows) and len(rows) == 5000
    assert read_in_order(spark, write_table(df.limit(0), str(tmp_path / "none"), order=["k"])).count() == 0


def test_geocoded_rows_are_dealt_evenly(spark):
    """The tiers' partitions differ much in size: what the cascade returns is dealt again, by size."""
    from parcelspark.plans.queries import geocoded_sales
    plan = geocoded_sales(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan
