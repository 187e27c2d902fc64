"""Stand-in inputs built from the driver's TPC-H-style test tables.

These functions only rename and reshape test-table columns into the schemas the library's
operators expect (sales rows, address reference rows, link rows, points, polygons, segments,
cells). They do none of the operators' work: filtering, keys, geocoding, spatial joins and
aggregation all happen in ``parcelspark.operators`` on whatever rows arrive here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, str], StructType] = {}      # of the given tables, which do not change; a read without one costs a job


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


# ---- fixed values: how the test tables stand in for the city data ---------------------------
SALE_NATURE_STANDIN = "F"          # l_linestatus value that plays the 'sale' nature
APARTMENT_STANDIN = "STANDARD"     # p_type that plays 'Appartement'
HOUSE_STANDIN = "ECONOMY"          # p_type that plays 'Maison'
# ---------------------------------------------------------------------------------------------


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders x customer x part as sales rows.

    district: a postal-code string ``75`` + 3-digit (nation + 1), decoded by the library;
    value = extended price, surface = quantity, rooms = part size, kind = part type,
    transaction = order|supplier|type. Raw address parts for the geocoder: department ``75``,
    commune ``101``, number = part size, suffix letter from the part type (``Q`` on first
    lines), street = brand; parcel = customer key; building stand-in = supplier key.
    Stand-in coordinates for the street/building grains: binary fractions from part and
    supplier keys, missing for every fifth part.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_brand")
    joined = (li.join(o, li.l_orderkey == o.o_orderkey)
                .join(c, o.o_custkey == c.c_custkey)
                .join(p, li.l_partkey == p.p_partkey))
    suffix_letter = F.when(F.col("l_linenumber") == 1, F.lit("Q")).otherwise(part_suffix())
    lon = F.when(F.col("l_partkey") % 5 != 0, (F.col("l_partkey") % 641) / 128.0)
    lat = F.when(F.col("l_partkey") % 5 != 0, (F.col("l_suppkey") * 7 % 641) / 128.0)
    return joined.select(
        F.col("l_linestatus").alias("nature_mutation"),
        F.concat(F.lit("75"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 3, "0")).alias("postal_code"),
        F.year("o_orderdate").alias("year"),
        F.col("l_extendedprice").alias("sale_value_eur"),
        F.col("l_quantity").alias("built_surface_m2"),
        F.col("p_size").cast("double").alias("rooms"),
        F.col("p_type").alias("property_type"),
        F.concat_ws("|", "l_orderkey", "l_suppkey", "p_type").alias("transaction_id"),
        F.lit("75").alias("dep_code"),
        F.lit("101").alias("commune_code"),
        F.col("p_size").cast("string").alias("raw_number"),
        suffix_letter.alias("raw_suffix"),
        F.col("p_brand").alias("raw_street"),
        F.col("o_custkey").cast("string").alias("parcel_id"),
        F.col("l_suppkey").cast("string").alias("supplier_id"),
        lon.alias("longitude"), lat.alias("latitude"),
        "l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "c_nationkey",
    )


def part_suffix():
    """Suffix letter of a part type (the address reference and the sales rows share it)."""
    return (F.when(F.col("p_type") == "STANDARD", F.lit("B"))
             .when(F.col("p_type") == "ECONOMY", F.lit("t")))


def address_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as raw address reference rows (all text, like the address CSV)."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("cle_interop"),
        F.when(F.col("p_size") <= 45, F.lit("75101")).otherwise(F.lit("92101")).alias("commune_insee"),
        F.col("p_brand").alias("voie_nom"),
        F.col("p_size").cast("string").alias("numero"),
        part_suffix().alias("suffixe"),
        F.when(F.col("p_size") % 10 != 1, (F.col("p_retailprice") / 400.0).cast("string")).alias("long"),
        (F.col("p_size") / 8.0).cast("string").alias("lat"),
        F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 3).cast("string"))
         .alias("certification_commune"),
    )


# ---- fixed values: link types of the event types ---------------------------------------------
LINK_TYPE_BY_EVENT = {"purchase": "GEO", "view": "BAN", "click": "OTHER", "signup": "BAN"}
# ---------------------------------------------------------------------------------------------


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the stored parcel -> address link table: parcel = user, address = the part at the
    event's place among all parts, link type from the event type (``error`` has none), address
    count from the value (missing for ``click``); ``signup`` events of odd id carry an empty address (the
    negative cache). ``seq`` is the row order of the stored table (event id)."""
    e = table(spark, sf_dir, "events")
    n_parts = table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()
    ltype = F.try_element_at(F.create_map(*[F.lit(x) for kv in LINK_TYPE_BY_EVENT.items() for x in kv]),
                             F.col("event_type"))
    empty = (F.col("event_type") == "signup") & (F.col("event_id") % 2 == 1)
    return e.select(
        F.col("user_id").cast("string").alias("idu"),
        F.when(empty, F.lit("")).otherwise(
            F.concat(F.lit("P"), (F.col("event_id") % n_parts).cast("string"))).alias("id_adr"),
        ltype.alias("type_lien"),
        F.when(F.col("event_type") != "click", F.floor(F.col("value")).cast("string")).alias("nb_adr"),
        F.lit("1").alias("nb_parc"),
        F.col("event_id").alias("seq"),
    )


def delivered_link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a delivered link batch: parcel = customer, address = order priority, no link type,
    address count from the total price, ``seq`` = order key (delivery order)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").cast("string").alias("idu"),
        F.col("o_orderpriority").alias("id_adr"),
        F.lit(None).cast("string").alias("type_lien"),
        F.floor(F.col("o_totalprice") / 1000).cast("string").alias("nb_adr"),
        F.col("o_orderkey").cast("string").alias("nb_parc"),
        F.col("o_orderkey").alias("seq"),
    )


def income_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as census-block income rows (text, French decimal commas): block code
    ``751`` + 2-digit (nation + 1) + customer key; machine-building customers have ``ns``
    poverty values; blocks of nation 24 carry a non-city code."""
    c = table(spark, sf_dir, "customer")
    fr = lambda col: F.regexp_replace(col.cast("string"), "[.]", ",")
    code = F.when(F.col("c_nationkey") == 24, F.lit("92")).otherwise(F.lit("751"))
    return c.select(
        F.concat(code, F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"),
                 F.col("c_custkey").cast("string")).alias("IRIS"),
        fr(F.col("c_acctbal")).alias("DEC_MED21"),
        F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("ns"))
         .otherwise(fr(F.abs(F.col("c_acctbal")) / 100.0)).alias("DEC_TP6021"),
        fr(F.col("c_acctbal") - 500.0).alias("DEC_Q121"),
        fr(F.col("c_acctbal") + 500.0).alias("DEC_Q321"),
        fr((F.col("c_custkey") % 100).cast("double")).alias("DEC_PIMP21"),
    )


def rent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer as rent-cap rows (text): quarter code ``751`` + 2-digit (nation + 1)
    + 2 digits, written without the leading 7 for even customers (the reader pads it back),
    missing for low priority; rents from the total price, missing for status P."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    tail = F.concat(F.lit("51"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"),
                    F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    code = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("string"))
             .when(F.col("o_custkey") % 2 == 0, tail).otherwise(F.concat(F.lit("7"), tail)))
    ref = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 10000.0)
    fr = lambda col: F.regexp_replace(col.cast("string"), "[.]", ",")
    return j.select(
        F.year("o_orderdate").cast("string").alias("Année"),
        fr(ref).alias("Loyers de référence"),
        fr(ref * 1.2).alias("Loyers de référence majorés"),
        fr(ref * 0.7).alias("Loyers de référence minorés"),
        code.alias("Numéro INSEE du quartier"),
    )


def social_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer as social-housing programme rows (text): district = nation + 1
    (21..25 fall outside the city), year of order, programme = customer, units from price;
    the three sub-counts exist only for some priorities / statuses."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    units = F.floor(F.col("o_totalprice") / 10000.0)
    return j.select(
        (F.col("c_nationkey") + 1).cast("string").alias("Arrondissement"),
        F.year("o_orderdate").cast("string").alias("Année du financement - agrément"),
        units.cast("string").alias("Nombre total de logements financés"),
        F.when(F.col("o_orderpriority") == "1-URGENT", units).cast("string").alias("Dont nombre de logements PLA I"),
        F.when(F.col("o_orderpriority") == "2-HIGH", units).cast("string").alias("Dont nombre de logements PLUS"),
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "3-MEDIUM"), units)
         .cast("string").alias("Dont nombre de logements PLS"),
        F.col("o_custkey").cast("string").alias("Identifiant livraison"),
    )


# ---- fixed values: octagon shape of the nation polygons (counter-clockwise offsets) ----------
OCTAGON_OFFSETS = [(0.5, -0.25), (0.5, 0.25), (0.25, 0.5), (-0.25, 0.5),
                   (-0.5, 0.25), (-0.5, -0.25), (-0.25, -0.5), (0.25, -0.5)]
# ---------------------------------------------------------------------------------------------


def octagon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as polygon features: an octagon centred at (k % 5 + 0.5, k div 5 + 0.5) written
    as GeoJSON Polygon coordinates text; neighbours share edges, gaps stay at the corners."""
    n = table(spark, sf_dir, "nation")
    cx = (F.col("n_nationkey") % 5).cast("double") + 0.5
    cy = F.floor(F.col("n_nationkey") / 5).cast("double") + 0.5
    pts = [F.concat(F.lit("["), (cx + dx).cast("string"), F.lit(","), (cy + dy).cast("string"), F.lit("]"))
           for dx, dy in OCTAGON_OFFSETS + OCTAGON_OFFSETS[:1]]
    coords = F.concat(F.lit("[["), F.concat_ws(",", *pts), F.lit("]]"))
    k1 = (F.col("n_nationkey") + 1).cast("string")
    props = F.create_map(
        F.lit("c_ar"), k1, F.lit("c_arinsee"), (F.col("n_nationkey") + 75101).cast("string"),
        F.lit("l_aroff"), F.col("n_name"), F.lit("l_ar"), F.concat(k1, F.lit("e")),
        F.lit("surface"), F.lit("0.875"), F.lit("perimetre"), F.lit("3.414"))
    return n.select(
        F.col("n_nationkey").alias("feature_id"),
        (F.col("n_nationkey") + 1).alias("arrondissement"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("region"),
        props.alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))


def quarter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation octagons with quarter properties (id ``751`` + 2-digit district + 2-digit number)."""
    feats = octagon_features(spark, sf_dir)
    k1 = F.col("arrondissement").cast("string")
    props = F.create_map(
        F.lit("c_quinsee"), F.concat(F.lit("751"), F.lpad(k1, 2, "0"), F.lit("01")), F.lit("c_qu"), k1,
        F.lit("c_ar"), k1, F.lit("l_qu"), F.col("name"), F.lit("surface"), F.lit("0.875"), F.lit("perimetre"), F.lit("3.414"))
    return feats.select(props.alias("properties"), "geometry")


def block_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation octagons as census-block text rows, the polygon as GeoJSON text; region 0 lies in
    another department."""
    feats = octagon_features(spark, sf_dir)
    k1 = F.lpad(F.col("arrondissement").cast("string"), 2, "0")
    dep = F.when(F.col("region") == 0, F.lit("92")).otherwise(F.lit("75"))
    return feats.select(
        F.concat(dep, F.lit("1"), k1, F.lit("0101")).alias("CODE_IRIS"), F.col("name").alias("NOM_IRIS"),
        F.concat(F.lit("T"), F.col("region").cast("string")).alias("TYP_IRIS"), dep.alias("DEP"),
        F.concat(dep, F.lit("1"), k1).alias("INSEE_COM"),
        F.to_json(F.struct(F.col("geometry.type").alias("type"),
                           F.from_json("geometry.coordinates", "array<array<array<double>>>").alias("coordinates"))).alias("Geo Shape"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points on binary fractions: x = (e % 641) / 128, y = (7e % 641) / 128."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id",
                    ((F.col("event_id") % 641) / 128.0).alias("x"),
                    ((F.col("event_id") * 7 % 641) / 128.0).alias("y"))


def cell_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as classified rectangular cells: class = air (1..3) * 10 + noise (1..3),
    centre from order and part keys, half sizes from quantity and discount (zero discount gives
    a zero-area cell)."""
    li = table(spark, sf_dir, "lineitem")
    cx = (F.col("l_orderkey") % 641) / 128.0
    cy = (F.col("l_partkey") * 7 % 641) / 128.0
    w = F.col("l_quantity") / 256.0
    h = F.col("l_discount") * 2.0
    return li.select(
        ((F.col("l_linenumber") % 3 + 1) * 10 + (F.col("l_partkey") % 3 + 1)).alias("category"),
        (cx - w).alias("minx"), (cy - h).alias("miny"), (cx + w).alias("maxx"), (cy + h).alias("maxy"))


def supplier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier as one-segment street lines ((37s % 101)/20, (53s % 103)/20) ->
    ((71s % 107)/20, (29s % 97)/20), GeoJSON LineString coordinates text."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    pt = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    coords = F.concat(F.lit("["), pt((k * 37 % 101) / 20.0, (k * 53 % 103) / 20.0), F.lit(","),
                      pt((k * 71 % 107) / 20.0, (k * 29 % 97) / 20.0), F.lit("]"))
    return s.select("s_suppkey", "s_name",
                    F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))


def part_street_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as street features: one segment per part on the same rule as the supplier lines,
    named by brand; raw street properties as text (designation empty, link word empty, name =
    brand, long display name = part name for odd parts, ids: none, empty, '0', part key)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pt = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    coords = F.concat(F.lit("["), pt((k * 37 % 101) / 20.0, (k * 53 % 103) / 20.0), F.lit(","),
                      pt((k * 71 % 107) / 20.0, (k * 29 % 97) / 20.0), F.lit("]"))
    props = F.create_map(
        F.lit("c_desi"), F.lit(None).cast("string"), F.lit("c_liaison"), F.lit(""),
        F.lit("l_voie"), F.col("p_brand"), F.lit("n_sq_vo"), F.lit(None).cast("string"),
        F.lit("c_voie_vp"), F.lit(""), F.lit("c_voie"), F.lit("0"),
        F.lit("objectid"), k.cast("string"),
        F.lit("l_longmin"), F.when(k % 2 == 1, F.col("p_name")))
    return p.select(k.alias("feature_id"), props.alias("properties"),
                    F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates")).alias("geometry"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as free text (whole texts)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def raw_street_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as raw street-name parts: a street-type abbreviation by size class (AV, bd, Pl,
    none), a link word for every third size, and the part name as the name."""
    p = table(spark, sf_dir, "part")
    desi = (F.when(F.col("p_size") % 4 == 0, F.lit("AV")).when(F.col("p_size") % 4 == 1, F.lit("bd"))
             .when(F.col("p_size") % 4 == 2, F.lit(" Pl ")))
    liaison = F.when(F.col("p_size") % 3 == 0, F.lit("de l'")).otherwise(F.lit(""))
    return p.select("p_partkey", desi.alias("c_desi"), liaison.alias("c_liaison"), F.col("p_name").alias("l_voie"))


def french_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer balances written the French way (space or no-break space thousands separator,
    decimal comma); some rows carry unparsable text."""
    c = table(spark, sf_dir, "customer")
    sep = F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.lit(" "))
    us = F.format_number("c_acctbal", 2)
    fr = F.translate(F.regexp_replace(us, ",", "#"), ".", ",")
    fr = F.regexp_replace(fr, "#", sep)
    raw = (F.when(F.col("c_custkey") % 17 == 0, F.lit("n/a"))
            .when(F.col("c_custkey") % 19 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("d")))
            .otherwise(fr))
    return c.select("c_custkey", raw.alias("amount_text"))


def postal_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer postal-code text: the special 16th-district code, codes with a space, other
    departments, missing and junk values, and plain 750xx codes from the nation."""
    c = table(spark, sf_dir, "customer")
    n2 = F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0")
    code = (F.when(F.col("c_custkey") % 7 == 0, F.lit("75116"))
             .when(F.col("c_custkey") % 7 == 1, F.concat(F.lit("75 0"), n2))
             .when(F.col("c_custkey") % 7 == 2, F.concat(F.lit("690"), n2))
             .when(F.col("c_custkey") % 7 == 4, F.lit("abc"))
             .when(F.col("c_custkey") % 7 != 3, F.concat(F.lit("750"), n2)))
    return c.select("c_custkey", code.alias("postal_code"),
                    F.concat(F.lit("751"), n2, F.col("c_custkey").cast("string")).alias("block_code"))


def raw_sale_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the raw address / parcel parts of a sale (all text)."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.lit("75").alias("Code departement"),
        F.when(F.col("p_size") % 10 != 0, (F.col("p_size") % 25).cast("string")).alias("Code commune"),
        F.when(k % 3 != 0, (k % 1000).cast("string")).alias("Prefixe de section"),
        F.concat(F.lower(F.substring("p_brand", 7, 2)), F.lit(" "), F.substring("p_type", 1, 1)).alias("Section"),
        F.when(k % 11 != 0, k.cast("string")).alias("No plan"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("No voie"),
        F.when(F.col("p_type") == "STANDARD", F.lit("b")).when(F.col("p_type") == "PROMO", F.lit("Q"))
         .alias("B/T/Q"),
        F.when(F.col("p_size") % 2 == 0, F.lit("AV")).otherwise(F.lit("BD")).alias("Type de voie"),
        F.col("p_name").alias("Voie"),
        F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("Date mutation"),
        F.translate(F.col("p_retailprice").cast("string"), ".", ",").alias("Valeur fonciere"),
        F.col("p_type").alias("Type local"),
        F.col("p_size").cast("string").alias("Surface reelle bati"),
    )


def nation_lon_lat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as WGS84 points around the city (lon 2.2 + k/100, lat 48.8 + k/200)."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", (F.lit(2.2) + F.col("n_nationkey") / 100.0).alias("lon"),
                    (F.lit(48.8) + F.col("n_nationkey") / 200.0).alias("lat"))


def national_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer as rows of the national sales text (all text columns), with the
    yearly file name ``valeursfoncieres=<year>`` as a column to write one folder per year."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    j = o.join(c, o.o_custkey == c.c_custkey)
    n1 = (F.col("c_nationkey") + 1).cast("string")
    kind = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Appartement"))
             .when(F.col("o_orderpriority") == "2-HIGH", F.lit("Maison")).otherwise(F.lit("Dépendance")))
    return j.select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date mutation"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Vente")).otherwise(F.lit("Echange")).alias("Nature mutation"),
        F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("Valeur fonciere"),
        (F.col("o_orderkey") % 200).cast("string").alias("No voie"),
        F.lit(None).cast("string").alias("B/T/Q"),
        F.lit("RUE").alias("Type de voie"),
        F.col("c_name").alias("Voie"),
        F.concat(F.lit("75"), F.lpad(n1, 3, "0")).alias("Code postal"),
        (F.col("c_nationkey") % 5 + 73).cast("string").alias("Code departement"),
        F.lpad(n1, 3, "0").alias("Code commune"),
        F.lit("").alias("Prefixe de section"),
        F.lit("AB").alias("Section"),
        (F.col("o_orderkey") % 9999).cast("string").alias("No plan"),
        F.lit(None).cast("string").alias("Reference document"),
        F.lit(None).cast("string").alias("Identifiant de document"),
        kind.alias("Type local"),
        (F.col("o_custkey") % 200).cast("string").alias("Surface reelle bati"),
        (F.col("o_custkey") % 7).cast("string").alias("Nombre pieces principales"),
        F.year("o_orderdate").alias("valeursfoncieres"),
    )
