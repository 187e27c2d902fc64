"""DuckDB SQL twins of the registered queries (run by the driver on the same parquet tables).

Rounding twin of numpy/Spark ``rint``: ``round_even(x * 10^n, 0) / 10^n``. Boolean shares use
DOUBLE literals (DECIMAL literals would change the average's precision).
"""

from __future__ import annotations

# ---- fixed values, written out here so that the twins do not share the library's tables ----------
METRICS = ["transactions", "median_price_m2", "median_sale_value_eur", "median_surface_m2", "median_rooms",
           "apartment_share_pct", "house_share_pct"]
STREET_ALIASES = {
    "ALL": "ALLEE", "AV": "AVENUE", "BD": "BOULEVARD", "BLD": "BOULEVARD", "CHE": "CHEMIN", "CRS": "COURS",
    "FG": "FAUBOURG", "IMP": "IMPASSE", "PAS": "PASSAGE", "PL": "PLACE", "QU": "QUAI", "RLE": "RUELLE",
    "RTE": "ROUTE", "SQ": "SQUARE", "VLA": "VILLA",
}
CATALOG_ROWS = [
    ("median_price_m2", "Prix median au m²", "EUR/m²", True),
    ("transactions", "Transactions retenues", "count", True),
    ("median_surface_m2", "Surface mediane", "m²", True),
    ("median_income_eur", "Revenu median", "EUR/an", False),
    ("reference_rent_majorated_eur_m2", "Loyer majore moyen", "EUR/m²", False),
    ("social_units_financed", "Logements sociaux finances", "count", True),
    ("social_units_financed_5y", "Logements sociaux finances sur 5 ans", "count", False),
    ("months_income_for_1sqm", "Mois de revenu pour 1 m²", "months", False),
    ("estimated_50m2_rent_effort_pct", "Effort locatif estime pour 50 m²", "%", False),
    ("quality_of_life_score", "Qualite de vie", "/10", False),
]
COMPARE_METRICS = ["median_price_m2", "median_income_eur", "reference_rent_majorated_eur_m2",
                   "social_units_financed", "quality_of_life_score", "months_income_for_1sqm",
                   "estimated_50m2_rent_effort_pct"]
MEDIAN_FILL = ["reference_rent_eur_m2", "reference_rent_majorated_eur_m2", "reference_rent_minorated_eur_m2",
               "median_income_eur", "poverty_rate_pct", "first_quartile_income_eur", "third_quartile_income_eur",
               "share_taxable_pct"]
ENV_FILL = {"noise_score": 2.0, "air_score": 2.0, "high_noise_share_pct": 50.0}
# Lambert-93 as published by the mapping agency: exponent, constant, pole, first eccentricity
LAMBERT_N, LAMBERT_C, LAMBERT_XS, LAMBERT_YS = "0.7256077650532670", "11754255.4260960", "700000.0", "12655612.0498760"
GRS80_E = "0.0818191910428158"
# ---------------------------------------------------------------------------------------------


def r(expr: str, n: int = 2) -> str:
    scale = f"{10 ** n}.0::DOUBLE"
    return f"round_even(({expr}) * {scale}, 0) / {scale}"


def norm(expr: str) -> str:
    """normalize_text for ASCII input (the test tables' brands and names)."""
    return (f"trim(regexp_replace(regexp_replace(upper({expr}), '[^A-Z0-9 ]+', ' ', 'g'), "
            f"' +', ' ', 'g'))")


SALES_CTE = """
sales AS (
  SELECT CAST(c_nationkey + 1 AS INTEGER) AS arrondissement, c_nationkey,
         CAST(year(o_orderdate) AS INTEGER) AS year,
         l_extendedprice AS sale_value_eur, l_quantity AS built_surface_m2,
         l_extendedprice / l_quantity AS price_per_m2, CAST(p_size AS DOUBLE) AS rooms,
         p_type AS property_type, p_brand, p_size, l_linenumber,
         CAST(o_custkey AS VARCHAR) AS parcel_id, CAST(l_suppkey AS VARCHAR) AS supplier_id,
         concat_ws('|', l_orderkey, l_suppkey, p_type) AS transaction_id,
         CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 641) / 128.0::DOUBLE END AS longitude,
         CASE WHEN l_partkey % 5 <> 0 THEN (l_suppkey * 7 % 641) / 128.0::DOUBLE END AS latitude,
         l_orderkey, l_suppkey, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
  WHERE l_linestatus = 'F' AND p_type IN ('STANDARD', 'ECONOMY')
    AND l_quantity > 10 AND l_extendedprice > 10000
    AND l_extendedprice / l_quantity BETWEEN 1000 AND 50000
    AND c_nationkey + 1 BETWEEN 1 AND 20
)"""

ADDR_SALES_CTE = SALES_CTE + f""",
addr_sales0 AS (
  SELECT *, '75101' AS commune_insee, CAST(p_size AS VARCHAR) AS house_number,
         CASE WHEN l_linenumber = 1 THEN 'QUATER' WHEN property_type = 'STANDARD' THEN 'BIS'
              WHEN property_type = 'ECONOMY' THEN 'TER' ELSE '' END AS house_suffix,
         {norm('p_brand')} AS street_name
  FROM sales
),
addr_sales AS (
  SELECT *, concat_ws('|', commune_insee, house_number, house_suffix, street_name) AS address_key,
         concat_ws('|', commune_insee, house_number, street_name) AS address_key_no_suffix
  FROM addr_sales0
)"""

MICRO_CTE = ADDR_SALES_CTE + """,
micro AS (
  SELECT *, commune_insee || '|' || street_name AS street_key,
         supplier_id AS building_id, 'ban_address' AS building_id_source,
         trim(regexp_replace(house_number || ' ' || house_suffix || ' ' || street_name, '\\s+', ' ', 'g'))
           AS building_label
  FROM addr_sales
)"""

REF_CTE = f"""
ref0 AS (
  SELECT 'P' || p_partkey AS cle_interop, '75101' AS commune_insee,
         CAST(p_size AS VARCHAR) AS house_number,
         CASE p_type WHEN 'STANDARD' THEN 'BIS' WHEN 'ECONOMY' THEN 'TER' ELSE '' END AS house_suffix,
         {norm('p_brand')} AS street_name,
         p_retailprice / 400.0::DOUBLE AS long, p_size / 8.0::DOUBLE AS lat,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 3 AS DOUBLE) ELSE 0.0::DOUBLE END AS certification
  FROM part WHERE p_size <= 45 AND p_size % 10 <> 1
),
ref AS (
  SELECT *, concat_ws('|', commune_insee, house_number, house_suffix, street_name) AS address_key,
         concat_ws('|', commune_insee, house_number, street_name) AS address_key_no_suffix
  FROM ref0
)"""


def dedupe(key: str) -> str:
    return (f"SELECT {key} AS lookup_key, "
            f"first(cle_interop ORDER BY certification DESC, cle_interop) AS cle_interop, "
            f"median(long) AS long, median(lat) AS lat FROM ref GROUP BY {key}")


LINKS_CTE = """
links AS (
  SELECT CAST(user_id AS VARCHAR) AS idu,
         CASE WHEN event_type = 'signup' AND event_id % 2 = 1 THEN ''
              ELSE 'P' || (event_id % (SELECT count(*) FROM part)) END AS id_adr,
         CASE event_type WHEN 'purchase' THEN 'GEO' WHEN 'view' THEN 'BAN'
              WHEN 'click' THEN 'OTHER' WHEN 'signup' THEN 'BAN' END AS type_lien,
         CASE WHEN event_type <> 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS nb_adr,
         '1' AS nb_parc, event_id AS seq
  FROM events
),
ranked_links AS (
  SELECT *, CASE type_lien WHEN 'GEO' THEN 0 WHEN 'BAN' THEN 1 ELSE 9 END AS prio,
         coalesce(TRY_CAST(nb_adr AS DOUBLE), 999999.0) AS nb
  FROM links WHERE id_adr IS NOT NULL AND id_adr <> ''
),
best AS (
  SELECT idu, first(id_adr ORDER BY prio, nb, id_adr) AS id_adr,
         first(type_lien ORDER BY prio, nb, id_adr) FILTER (WHERE type_lien IS NOT NULL) AS type_lien
  FROM ranked_links GROUP BY idu
)"""


def metric_block(extra: str = "") -> str:
    share = lambda kind: r(r(f"avg(CASE WHEN property_type = '{kind}' THEN 1::DOUBLE ELSE 0::DOUBLE END) * 100.0::DOUBLE", 1))
    return f"""count(DISTINCT transaction_id) AS transactions,
       {r('median(price_per_m2)')} AS median_price_m2,
       {r('median(sale_value_eur)')} AS median_sale_value_eur,
       {r('median(built_surface_m2)')} AS median_surface_m2,
       {r('median(rooms)')} AS median_rooms,
       {share('STANDARD')} AS apartment_share_pct,
       {share('ECONOMY')} AS house_share_pct{extra}"""


STREET_KEYS = "street_key, street_name, arrondissement, commune_insee, year"
BUILDING_KEYS = ("building_id, building_id_source, building_label, arrondissement, commune_insee, "
                 "street_name, house_number, house_suffix, year")
GEOCODED_TX = "count(DISTINCT CASE WHEN longitude IS NOT NULL THEN transaction_id END)"

INCOME_CTE = """
inc AS (
  SELECT CAST(c_nationkey + 1 AS INTEGER) AS arrondissement, c_acctbal AS med,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE abs(c_acctbal) / 100.0::DOUBLE END AS pov,
         c_acctbal - 500.0::DOUBLE AS q1, c_acctbal + 500.0::DOUBLE AS q3,
         CAST(c_custkey % 100 AS DOUBLE) AS pimp
  FROM customer WHERE c_nationkey <> 24
)"""

RENT_CTE = """
rent0 AS (
  SELECT CAST(c_nationkey + 1 AS INTEGER) AS arrondissement, CAST(year(o_orderdate) AS INTEGER) AS year,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 10000.0::DOUBLE END AS ref
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'
),
rent AS (
  SELECT arrondissement, year, {0} AS reference_rent_eur_m2,
         {1} AS reference_rent_majorated_eur_m2, {2} AS reference_rent_minorated_eur_m2,
         count(ref) AS rent_reference_count
  FROM rent0 GROUP BY arrondissement, year
)""".format(r("avg(ref)"), r("avg(ref * 1.2::DOUBLE)"), r("avg(ref * 0.7::DOUBLE)"))

SOCIAL_CTE = """
soc0 AS (
  SELECT CAST(c_nationkey + 1 AS INTEGER) AS arrondissement, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_custkey, floor(o_totalprice / 10000.0::DOUBLE) AS units, o_orderpriority, o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey + 1 BETWEEN 1 AND 20
),
social AS (
  SELECT arrondissement, year, count(DISTINCT o_custkey) AS program_count,
         {0} AS social_units_financed,
         {1} AS pla_i_units, {2} AS plus_units, {3} AS pls_units
  FROM soc0 GROUP BY arrondissement, year
)""".format(r("coalesce(sum(units), 0)", 0),
            r("coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN units END), 0)", 0),
            r("coalesce(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN units END), 0)", 0),
            r("coalesce(sum(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '3-MEDIUM' THEN units END), 0)", 0))

GEOCODE_CTE = ADDR_SALES_CTE + "," + REF_CTE + "," + LINKS_CTE + f""",
ws AS ({dedupe('address_key')}),
wos AS ({dedupe('address_key_no_suffix')}),
bi AS ({dedupe('cle_interop')}),
t1 AS (SELECT s.*, ws.cle_interop AS id1, ws.long AS lon1, ws.lat AS lat1
       FROM addr_sales s LEFT JOIN ws ON s.address_key = ws.lookup_key),
t2 AS (SELECT t1.*, wos.cle_interop AS id2, wos.long AS lon2, wos.lat AS lat2
       FROM t1 LEFT JOIN wos ON t1.lon1 IS NULL AND t1.address_key_no_suffix = wos.lookup_key),
t3 AS (SELECT t2.*, best.id_adr AS id3, bi.long AS lon3, bi.lat AS lat3
       FROM t2 LEFT JOIN best ON t2.lon1 IS NULL AND t2.lon2 IS NULL AND t2.parcel_id = best.idu
       LEFT JOIN bi ON best.id_adr = bi.lookup_key),
geo0 AS (
  SELECT *, CASE WHEN lon1 IS NOT NULL THEN id1 WHEN lon2 IS NOT NULL THEN id2 ELSE id3 END
              AS matched_cle_interop,
         coalesce(lon1, lon2, lon3) AS g_longitude, coalesce(lat1, lat2, lat3) AS g_latitude,
         CASE WHEN id1 IS NOT NULL OR id2 IS NOT NULL THEN 'adresses-ban'
              WHEN lon3 IS NOT NULL THEN 'ban-plus' END AS geocode_source
  FROM t3
),
geo AS (
  SELECT *, coalesce(nullif(matched_cle_interop, ''), nullif(parcel_id, ''), nullif(address_key, ''))
              AS building_id,
         CASE WHEN nullif(matched_cle_interop, '') IS NOT NULL THEN 'ban_address'
              WHEN nullif(parcel_id, '') IS NOT NULL THEN 'parcel'
              WHEN nullif(address_key, '') IS NOT NULL THEN 'address_key' END AS building_id_source,
         trim(regexp_replace(house_number || ' ' || house_suffix || ' ' || street_name, '\\s+', ' ', 'g'))
           AS label0
  FROM geo0
)"""


OCTAGON_CTE = """
oct_v AS (
  SELECT n_nationkey AS k, n_name, unnest(generate_series(0, 7)) AS i FROM nation
),
oct_p AS (
  SELECT k, n_name, i,
         CAST(k % 5 AS DOUBLE) + 0.5::DOUBLE
           + list_extract([0.5, 0.5, 0.25, -0.25, -0.5, -0.5, -0.25, 0.25]::DOUBLE[], i + 1) AS x,
         floor(k / 5) + 0.5::DOUBLE
           + list_extract([-0.25, 0.25, 0.5, 0.5, 0.25, -0.25, -0.5, -0.5]::DOUBLE[], i + 1) AS y
  FROM oct_v
),
edges AS (
  SELECT a.k, a.n_name, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
  FROM oct_p a JOIN oct_p b ON a.k = b.k AND b.i = (a.i + 1) % 8
)"""


def locate_sql(points: str, px: str, py: str) -> str:
    """Relational point-in-polygon: points x edges, odd crossings or on an edge, lowest key."""
    return f"""
SELECT p.{px} AS px, p.{py} AS py,
       min(k) FILTER (WHERE hit) AS k
FROM (
  SELECT p.{px}, p.{py}, e.k,
         sum(CASE WHEN (e.y1 > p.{py}) <> (e.y2 > p.{py})
                  THEN CASE WHEN p.{px} < e.x1 + (p.{py} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
                            THEN 1 ELSE 0 END
                  ELSE 0 END) % 2 = 1
         OR bool_or((e.x2 - e.x1) * (p.{py} - e.y1) - (e.y2 - e.y1) * (p.{px} - e.x1) = 0
                    AND p.{px} BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                    AND p.{py} BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS hit
  FROM (SELECT DISTINCT {px}, {py} FROM {points} WHERE {px} IS NOT NULL AND {py} IS NOT NULL) p
  JOIN edges e ON true
  GROUP BY p.{px}, p.{py}, e.k
) p
GROUP BY p.{px}, p.{py}"""


CELLS_CTE = """
cells0 AS (
  SELECT CAST((l_linenumber % 3 + 1) * 10 + (l_partkey % 3 + 1) AS INTEGER) AS cat,
         (l_orderkey % 641) / 128.0::DOUBLE - l_quantity / 256.0::DOUBLE AS minx,
         (l_partkey * 7 % 641) / 128.0::DOUBLE - l_discount * 2.0::DOUBLE AS miny,
         (l_orderkey % 641) / 128.0::DOUBLE + l_quantity / 256.0::DOUBLE AS maxx,
         (l_partkey * 7 % 641) / 128.0::DOUBLE + l_discount * 2.0::DOUBLE AS maxy
  FROM lineitem
),
cells AS (
  SELECT cat, (minx + maxx) / 2.0::DOUBLE AS cx, (miny + maxy) / 2.0::DOUBLE AS cy,
         greatest((maxx - minx) * (maxy - miny), 0.0::DOUBLE) AS area
  FROM cells0 WHERE greatest((maxx - minx) * (maxy - miny), 0.0::DOUBLE) > 0
)"""


ORACLE = {
    "q01_sales_district_year": f"""WITH {SALES_CTE}
SELECT arrondissement, year, {metric_block()}
FROM sales GROUP BY arrondissement, year""",

    "q03_sales_street_year": f"""WITH {MICRO_CTE}
SELECT {STREET_KEYS}, count(DISTINCT building_id) AS buildings,
       {GEOCODED_TX} AS geocoded_transactions,
       median(longitude) AS longitude, median(latitude) AS latitude, {metric_block()}
FROM micro GROUP BY {STREET_KEYS}""",

    "q04_sales_building_year": f"""WITH {MICRO_CTE}
SELECT {BUILDING_KEYS}, {GEOCODED_TX} AS geocoded_transactions,
       median(longitude) AS longitude, median(latitude) AS latitude,
       count(DISTINCT parcel_id) AS parcel_count, {metric_block()}
FROM micro GROUP BY {BUILDING_KEYS}""",

    "q05_income_by_district": f"""WITH {INCOME_CTE}
SELECT arrondissement, count(*) AS iris_count, {r('median(med)')} AS median_income_eur,
       {r('avg(pov)')} AS poverty_rate_pct, {r('median(q1)')} AS first_quartile_income_eur,
       {r('median(q3)')} AS third_quartile_income_eur, {r('avg(pimp)')} AS share_taxable_pct
FROM inc GROUP BY arrondissement""",

    "q06_rent_by_district_year": f"""WITH {RENT_CTE} SELECT * FROM rent""",

    "q07_social_by_district_year": f"""WITH {SOCIAL_CTE} SELECT * FROM social""",

    "q08_five_year_sum": f"""WITH {SOCIAL_CTE}
SELECT arrondissement, sum(social_units_financed) AS social_units_financed_5y
FROM social WHERE year >= (SELECT max(year) FROM social) - 4 GROUP BY arrondissement""",

    "q09_latest_year_rows": f"""WITH {SALES_CTE}, {RENT_CTE}, {SOCIAL_CTE}
SELECT 'sales' AS theme, max(year) AS latest_year,
       string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM sales
UNION ALL
SELECT 'rents', max(year), string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FROM rent
UNION ALL
SELECT 'social', max(year), string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FROM social""",

    "q10_reference_dedupe": f"""WITH {REF_CTE} {dedupe('address_key')}""",

    "q11_lookup_cascade": f"""WITH {GEOCODE_CTE}
SELECT transaction_id, address_key, parcel_id, matched_cle_interop, g_longitude AS longitude,
       g_latitude AS latitude, geocode_source, building_id, building_id_source,
       coalesce(nullif(label0, ''), building_id) AS building_label
FROM geo""",

    "q12_best_link": f"""WITH {LINKS_CTE} SELECT idu, id_adr, type_lien FROM best""",

    "q13_anti_missing_ids": f"""WITH {GEOCODE_CTE}
SELECT DISTINCT parcel_id AS idu FROM t2 s
WHERE lon1 IS NULL AND lon2 IS NULL AND parcel_id IS NOT NULL AND parcel_id <> ''
  AND NOT EXISTS (SELECT 1 FROM links l WHERE l.idu = s.parcel_id)""",

    "q14_merge_keep_last": f"""WITH {LINKS_CTE},
both_batches AS (
  SELECT idu, id_adr, type_lien, nb_adr, nb_parc, seq FROM links
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), o_orderpriority, NULL, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR),
         CAST(o_orderkey AS VARCHAR), (SELECT max(seq) FROM links) + 1 + o_orderkey FROM orders
)
SELECT idu, id_adr, type_lien,
       first(nb_adr ORDER BY seq DESC) AS nb_adr,
       first(nb_parc ORDER BY seq DESC) AS nb_parc, max(seq) AS seq
FROM both_batches GROUP BY idu, id_adr, type_lien""",

    "q02_sales_quarter_year": f"""WITH {SALES_CTE}, {OCTAGON_CTE},
loc AS ({locate_sql('sales', 'longitude', 'latitude')}),
q AS (
  SELECT s.*, CAST(loc.k AS VARCHAR) AS quartier_id, n.n_name AS quartier_name
  FROM sales s JOIN loc ON s.longitude = loc.px AND s.latitude = loc.py
  JOIN nation n ON n.n_nationkey = loc.k
  WHERE loc.k IS NOT NULL
)
SELECT quartier_id, quartier_name, arrondissement, year, {metric_block()}
FROM q GROUP BY quartier_id, quartier_name, arrondissement, year""",

    "q15_point_in_polygon": f"""WITH {OCTAGON_CTE},
pts AS (SELECT event_id, (event_id % 641) / 128.0::DOUBLE AS x,
               (event_id * 7 % 641) / 128.0::DOUBLE AS y FROM events),
loc AS ({locate_sql('pts', 'x', 'y')})
SELECT pts.event_id, CAST(loc.k AS INTEGER) AS n_nationkey
FROM pts LEFT JOIN loc ON pts.x = loc.px AND pts.y = loc.py""",

    "q16_weighted_exposure": f"""WITH {OCTAGON_CTE}, {CELLS_CTE},
loc AS ({locate_sql('cells', 'cx', 'cy')}),
per AS (
  SELECT loc.k, count(*) AS n, sum(area) AS total, sum((cat % 10) * area) AS noise,
         sum((cat // 10) * area) AS air, sum(CASE WHEN cat % 10 = 3 THEN area ELSE 0.0 END) AS high
  FROM cells JOIN loc ON cells.cx = loc.px AND cells.cy = loc.py
  WHERE loc.k IS NOT NULL GROUP BY loc.k
)
SELECT n_nationkey AS arrondissement,
       {r('coalesce(noise, 0.0) / coalesce(total, 1.0)', 3)} AS noise_score,
       {r('coalesce(air, 0.0) / coalesce(total, 1.0)', 3)} AS air_score,
       {r('coalesce(high, 0.0) / coalesce(total, 1.0) * 100.0::DOUBLE', 2)} AS high_noise_share_pct,
       coalesce(n, 0) AS noise_cell_count
FROM nation LEFT JOIN per ON per.k = n_nationkey""",
}


def clip_sql(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x})) END"


ENV_EXPR = r(clip_sql("((noise_score - 1.0::DOUBLE) / 2.0::DOUBLE) * 60.0::DOUBLE + ((air_score - 1.0::DOUBLE) / 2.0::DOUBLE) * 40.0::DOUBLE", 0.0, 100.0), 1)
QOL_EXPR = r("10.0::DOUBLE * (0.3::DOUBLE * {0} + 0.3::DOUBLE * {1} + 0.25::DOUBLE * {2} + 0.15::DOUBLE * {3})".format(
    clip_sql("1.0::DOUBLE - ((noise_score - 1.0::DOUBLE) / 2.0::DOUBLE)", 0.0, 1.0),
    clip_sql("1.0::DOUBLE - ((air_score - 1.0::DOUBLE) / 2.0::DOUBLE)", 0.0, 1.0),
    clip_sql("1.0::DOUBLE - (high_noise_share_pct / 100.0::DOUBLE)", 0.0, 1.0),
    clip_sql("1.0::DOUBLE - (environmental_pressure_index / 100.0::DOUBLE)", 0.0, 1.0)), 2)

MONTHS_EXPR = r("median_price_m2 / (median_income_eur / 12.0::DOUBLE)")

SUMMARY_CTE = f"""{SALES_CTE}, {INCOME_CTE}, {RENT_CTE}, {SOCIAL_CTE}, {OCTAGON_CTE}, {CELLS_CTE},
sales_yearly AS (SELECT arrondissement, year, {metric_block()} FROM sales GROUP BY arrondissement, year),
income AS (
  SELECT arrondissement, count(*) AS iris_count, {r('median(med)')} AS median_income_eur,
         {r('avg(pov)')} AS poverty_rate_pct, {r('median(q1)')} AS first_quartile_income_eur,
         {r('median(q3)')} AS third_quartile_income_eur, {r('avg(pimp)')} AS share_taxable_pct
  FROM inc GROUP BY arrondissement
),
cloc AS ({locate_sql('cells', 'cx', 'cy')}),
cper AS (
  SELECT cloc.k, count(*) AS n, sum(area) AS total, sum((cat % 10) * area) AS noise,
         sum((cat // 10) * area) AS air, sum(CASE WHEN cat % 10 = 3 THEN area ELSE 0.0 END) AS high
  FROM cells JOIN cloc ON cells.cx = cloc.px AND cells.cy = cloc.py
  WHERE cloc.k IS NOT NULL GROUP BY cloc.k
),
env AS (
  SELECT CAST(n_nationkey + 1 AS INTEGER) AS arrondissement,
         {r('coalesce(noise, 0.0) / coalesce(total, 1.0)', 3)} AS noise_score,
         {r('coalesce(air, 0.0) / coalesce(total, 1.0)', 3)} AS air_score,
         {r('coalesce(high, 0.0) / coalesce(total, 1.0) * 100.0::DOUBLE', 2)} AS high_noise_share_pct,
         coalesce(n, 0) AS noise_cell_count
  FROM nation LEFT JOIN cper ON cper.k = n_nationkey
),
districts AS (
  SELECT CAST(n_nationkey + 1 AS INTEGER) AS arrondissement, n_name AS name,
         CAST(n_nationkey + 1 AS VARCHAR) || 'e' AS label, CAST(n_nationkey + 75101 AS INTEGER) AS insee_code,
         '75' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS postal_code,
         {r('0.875::DOUBLE')} AS surface_m2
  FROM nation
),
s5 AS (
  SELECT arrondissement, sum(social_units_financed) AS social_units_financed_5y
  FROM social WHERE year >= (SELECT max(year) FROM social) - 4 GROUP BY arrondissement
),
joined AS (
  SELECT d.*, sy.year, {', '.join('sy.' + m for m in METRICS)},
         i.iris_count, i.median_income_eur, i.poverty_rate_pct, i.first_quartile_income_eur,
         i.third_quartile_income_eur, i.share_taxable_pct,
         rt.year AS year_rent, rt.reference_rent_eur_m2, rt.reference_rent_majorated_eur_m2,
         rt.reference_rent_minorated_eur_m2, rt.rent_reference_count,
         so.year AS year_social, so.program_count, so.social_units_financed, so.pla_i_units,
         so.plus_units, so.pls_units, s5.social_units_financed_5y,
         e.noise_score, e.air_score, e.high_noise_share_pct, e.noise_cell_count,
         (SELECT max(year) FROM sales_yearly) AS sales_year, (SELECT max(year) FROM rent) AS rent_year,
         (SELECT max(year) FROM social) AS social_year
  FROM districts d
  LEFT JOIN (SELECT * FROM sales_yearly WHERE year = (SELECT max(year) FROM sales_yearly)) sy USING (arrondissement)
  LEFT JOIN income i USING (arrondissement)
  LEFT JOIN (SELECT * FROM rent WHERE year = (SELECT max(year) FROM rent)) rt USING (arrondissement)
  LEFT JOIN (SELECT * FROM social WHERE year = (SELECT max(year) FROM social)) so USING (arrondissement)
  LEFT JOIN s5 USING (arrondissement)
  LEFT JOIN env e USING (arrondissement)
),
filled AS (
  SELECT * REPLACE (
    coalesce(social_units_financed, 0) AS social_units_financed,
    coalesce(social_units_financed_5y, 0) AS social_units_financed_5y,
    coalesce(program_count, 0) AS program_count,
    {', '.join(f'coalesce({c}, median({c}) OVER ()) AS {c}' for c in MEDIAN_FILL)},
    {', '.join(f'coalesce({c}, median({c}) OVER (), {d}::DOUBLE) AS {c}' for c, d in ENV_FILL.items())}
  ) FROM joined
),
ind AS (
  SELECT *, {MONTHS_EXPR} AS months_income_for_1sqm,
         {r('reference_rent_majorated_eur_m2 * 50.0::DOUBLE / (median_income_eur / 12.0::DOUBLE) * 100.0::DOUBLE', 1)}
           AS estimated_50m2_rent_effort_pct,
         {r('coalesce(social_units_financed / nullif(transactions, 0) * 100.0::DOUBLE, 0.0::DOUBLE)', 1)}
           AS social_units_per_100_sales,
         {ENV_EXPR} AS environmental_pressure_index
  FROM filled
),
summary AS (SELECT *, {QOL_EXPR} AS quality_of_life_score FROM ind)"""


def overview_sql(year: str) -> str:
    return f"""{SUMMARY_CTE},
ov0 AS (
  SELECT s.* EXCLUDE ({', '.join(METRICS)}, months_income_for_1sqm), {', '.join('y.' + m for m in METRICS)}
  FROM summary s LEFT JOIN (SELECT * FROM sales_yearly WHERE year = {year}) y USING (arrondissement)
),
ov1 AS (SELECT *, {MONTHS_EXPR} AS months_income_for_1sqm FROM ov0),
overview AS (
  SELECT *, CAST(CASE WHEN median_price_m2 IS NOT NULL
                  THEN rank() OVER (ORDER BY median_price_m2 DESC NULLS LAST) END AS INTEGER) AS rank_by_price,
         CAST({year} AS INTEGER) AS selected_sales_year
  FROM ov1
)"""


def long_sql(table: str, theme: str, cols: list[str], where: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{theme}' AS theme, year, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM {table} WHERE {where}"
        for c in cols)


CITY_SQL = f"""SELECT count(DISTINCT arrondissement) AS arrondissement_count,
       {r('median(median_price_m2)')} AS median_price_m2, {r('median(median_income_eur)')} AS median_income_eur,
       {r('median(reference_rent_majorated_eur_m2)')} AS reference_rent_majorated_eur_m2,
       CAST(sum(social_units_financed) AS BIGINT) AS social_units_financed,
       CAST(sum(social_units_financed_5y) AS BIGINT) AS social_units_financed_5y,
       {r('median(quality_of_life_score)')} AS quality_of_life_score,
       {r('median(months_income_for_1sqm)')} AS months_income_for_1sqm,
       {r('median(estimated_50m2_rent_effort_pct)', 1)} AS estimated_50m2_rent_effort_pct
FROM summary"""


ORACLE.update({
    "q18_summary": f"WITH {SUMMARY_CTE} SELECT * FROM summary",
    "q19_quality_score": f"""WITH {OCTAGON_CTE}, {CELLS_CTE},
loc AS ({locate_sql('cells', 'cx', 'cy')}),
per AS (
  SELECT loc.k, count(*) AS n, sum(area) AS total, sum((cat % 10) * area) AS noise,
         sum((cat // 10) * area) AS air, sum(CASE WHEN cat % 10 = 3 THEN area ELSE 0.0 END) AS high
  FROM cells JOIN loc ON cells.cx = loc.px AND cells.cy = loc.py
  WHERE loc.k IS NOT NULL GROUP BY loc.k
),
env AS (
  SELECT n_nationkey AS arrondissement,
         {r('coalesce(noise, 0.0) / coalesce(total, 1.0)', 3)} AS noise_score,
         {r('coalesce(air, 0.0) / coalesce(total, 1.0)', 3)} AS air_score,
         {r('coalesce(high, 0.0) / coalesce(total, 1.0) * 100.0::DOUBLE', 2)} AS high_noise_share_pct,
         coalesce(n, 0) AS noise_cell_count
  FROM nation LEFT JOIN per ON per.k = n_nationkey
),
ind AS (SELECT *, {ENV_EXPR} AS environmental_pressure_index FROM env)
SELECT *, {QOL_EXPR} AS quality_of_life_score FROM ind""",
    "q20_city_rollup": f"WITH {SUMMARY_CTE} {CITY_SQL}",
    "q21_overview_rank": f"WITH {overview_sql('1998')} SELECT * FROM overview",
    "q22_timeline": f"""WITH {SALES_CTE}, {RENT_CTE}, {SOCIAL_CTE},
sales_yearly AS (SELECT arrondissement, year, {metric_block()} FROM sales GROUP BY arrondissement, year),
series AS (
{long_sql('sales_yearly', 'sales', METRICS, 'arrondissement = 7')}
UNION ALL
{long_sql('social', 'social', ['program_count', 'social_units_financed', 'pla_i_units', 'plus_units', 'pls_units'], 'arrondissement = 7')}
UNION ALL
{long_sql('rent', 'rents', ['reference_rent_eur_m2', 'reference_rent_majorated_eur_m2', 'reference_rent_minorated_eur_m2', 'rent_reference_count'], 'arrondissement = 7')})
SELECT 7 AS arrondissement, (SELECT n_name FROM nation WHERE n_nationkey = 6) AS name, theme, year, metric, value FROM series""",
    "q23_compare": f"""WITH {overview_sql('(SELECT max(year) FROM sales_yearly)')},
lng AS ({long_sql('overview', 'x', COMPARE_METRICS, 'arrondissement IN (3, 11)').replace("'x' AS theme, year,", "arrondissement,")}),
pair AS (
  SELECT metric, max(CASE WHEN arrondissement = 3 THEN value END) AS left_value,
         max(CASE WHEN arrondissement = 11 THEN value END) AS right_value
  FROM lng GROUP BY metric
)
SELECT (SELECT max(selected_sales_year) FROM overview) AS sales_year, 3 AS "left",
       (SELECT n_name FROM nation WHERE n_nationkey = 2) AS left_name, 11 AS "right",
       (SELECT n_name FROM nation WHERE n_nationkey = 10) AS right_name, metric, left_value, right_value,
       {r('left_value - right_value')} AS delta
FROM pair WHERE left_value IS NOT NULL AND right_value IS NOT NULL""",
    "q40_neutral_environment": """SELECT CAST(n_nationkey + 1 AS INTEGER) AS arrondissement, 2.0::DOUBLE AS noise_score,
       2.0::DOUBLE AS air_score, 50.0::DOUBLE AS high_noise_share_pct, CAST(0 AS BIGINT) AS noise_cell_count
FROM nation""",
})


SEGMENTS_CTE = """
seg AS (
  SELECT s_suppkey, (s_suppkey * 37 % 101) / 20.0::DOUBLE AS ax, (s_suppkey * 53 % 103) / 20.0::DOUBLE AS ay,
         (s_suppkey * 71 % 107) / 20.0::DOUBLE AS bx, (s_suppkey * 29 % 97) / 20.0::DOUBLE AS by_
  FROM supplier
)"""

ORACLE["q17_line_overlay"] = f"""WITH {OCTAGON_CTE}, {SEGMENTS_CTE},
hp AS (
  SELECT s.s_suppkey, e.k,
         -(e.y2 - e.y1) * (s.ax - e.x1) + (e.x2 - e.x1) * (s.ay - e.y1) AS f0,
         -(e.y2 - e.y1) * (s.bx - s.ax) + (e.x2 - e.x1) * (s.by_ - s.ay) AS fd
  FROM seg s JOIN edges e ON true
),
clip AS (
  SELECT s_suppkey, k,
         greatest(0.0::DOUBLE, coalesce(max(CASE WHEN fd > 0 THEN -f0 / fd END), 0.0::DOUBLE)) AS t0,
         least(1.0::DOUBLE, coalesce(min(CASE WHEN fd < 0 THEN -f0 / fd END), 1.0::DOUBLE)) AS t1,
         bool_and(fd <> 0 OR f0 >= 0) AS ok
  FROM hp GROUP BY s_suppkey, k
)
SELECT c.s_suppkey, c.k AS n_nationkey,
       {r('(c.t1 - c.t0) * sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay))', 6)} AS clipped_length,
       1 AS parts
FROM clip c JOIN seg s USING (s_suppkey)
WHERE c.ok AND (c.t1 - c.t0) * sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)) > 1e-9"""



def segments_cte(table: str, key: str) -> str:
    k = key
    return f"""
seg AS (
  SELECT {k}, ({k} * 37 % 101) / 20.0::DOUBLE AS ax, ({k} * 53 % 103) / 20.0::DOUBLE AS ay,
         ({k} * 71 % 107) / 20.0::DOUBLE AS bx, ({k} * 29 % 97) / 20.0::DOUBLE AS by_
  FROM {table}
)"""


def clip_cte(key: str) -> str:
    return f"""
hp AS (
  SELECT s.{key}, e.k,
         -(e.y2 - e.y1) * (s.ax - e.x1) + (e.x2 - e.x1) * (s.ay - e.y1) AS f0,
         -(e.y2 - e.y1) * (s.bx - s.ax) + (e.x2 - e.x1) * (s.by_ - s.ay) AS fd
  FROM seg s JOIN edges e ON true
),
clip0 AS (
  SELECT {key}, k,
         greatest(0.0::DOUBLE, coalesce(max(CASE WHEN fd > 0 THEN -f0 / fd END), 0.0::DOUBLE)) AS t0,
         least(1.0::DOUBLE, coalesce(min(CASE WHEN fd < 0 THEN -f0 / fd END), 1.0::DOUBLE)) AS t1,
         bool_and(fd <> 0 OR f0 >= 0) AS ok
  FROM hp GROUP BY {key}, k
),
clip AS (
  SELECT c.*, (c.t1 - c.t0) * sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)) AS len
  FROM clip0 c JOIN seg s USING ({key})
  WHERE c.ok AND (c.t1 - c.t0) * sqrt((s.bx - s.ax) * (s.bx - s.ax) + (s.by_ - s.ay) * (s.by_ - s.ay)) > 1e-9
)"""


LATEST = "(SELECT max(year) FROM sales_yearly)"
LEVEL_ROWS = [("arrondissement", "Arrondissements", None), ("quartier", "Quartiers", 3),
              ("street", "Rues", 3), ("building", "Batiments", 3)]
MICRO = ("median_price_m2", "transactions", "median_surface_m2")

ORACLE.update({
    "q24_map_district": f"""WITH {overview_sql(LATEST)}
SELECT arrondissement, name, 3.41::DOUBLE AS perimeter_m, CAST(median_price_m2 AS DOUBLE) AS metric_value,
       'arrondissement' AS map_level, 'Arrondissements' AS level_label, 'median_price_m2' AS selected_metric, 'Prix median au m²' AS metric_label,
       'EUR/m²' AS metric_unit, true AS supports_year,
       selected_sales_year AS metric_year, 'Polygon' AS geometry_type
FROM overview""",

    "q25_map_quarter": f"""WITH {SALES_CTE}, {OCTAGON_CTE},
loc AS ({locate_sql('sales', 'longitude', 'latitude')}),
q AS (
  SELECT s.*, CAST(loc.k AS VARCHAR) AS quartier_id, n.n_name AS quartier_name
  FROM sales s JOIN loc ON s.longitude = loc.px AND s.latitude = loc.py
  JOIN nation n ON n.n_nationkey = loc.k WHERE loc.k IS NOT NULL
),
qy AS (SELECT quartier_id, quartier_name, arrondissement, year, {metric_block()}
       FROM q GROUP BY quartier_id, quartier_name, arrondissement, year),
sel AS (SELECT * FROM qy WHERE year = (SELECT max(year) FROM qy)),
last AS (SELECT quartier_id, max(arrondissement) AS arrondissement,
                arg_max(transactions, arrondissement) AS transactions FROM sel GROUP BY quartier_id)
SELECT CAST(n_nationkey AS VARCHAR) AS quartier_id,
       CAST(coalesce(last.arrondissement, n_nationkey + 1) AS INTEGER) AS arrondissement,
       CAST(last.transactions AS DOUBLE) AS metric_value,
       'quartier' AS map_level, 'Quartiers' AS level_label, 'transactions' AS selected_metric, 'Transactions retenues' AS metric_label,
       'count' AS metric_unit, true AS supports_year, CAST((SELECT max(year) FROM qy) AS INTEGER) AS metric_year
FROM nation LEFT JOIN last ON last.quartier_id = CAST(n_nationkey AS VARCHAR)""",

    "q26_map_street": f"""WITH {MICRO_CTE}, {OCTAGON_CTE}, {segments_cte('part', 'p_partkey')}, {clip_cte('p_partkey')},
sy AS (SELECT {STREET_KEYS}, {r('median(price_per_m2)')} AS median_price_m2 FROM micro GROUP BY {STREET_KEYS}),
sel AS (SELECT * FROM sy WHERE year = (SELECT max(year) FROM sy)),
last AS (SELECT street_key, max(arrondissement) AS arrondissement,
                arg_max(median_price_m2, arrondissement) AS median_price_m2 FROM sel GROUP BY street_key),
pieces AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS street_ref_id,
         CAST(75101 + c.k AS VARCHAR) || '|' || {norm('p.p_brand')} AS street_key,
         CASE WHEN trim(coalesce(CASE WHEN p.p_partkey % 2 = 1 THEN p.p_name END, trim(p.p_brand))) <> ''
              THEN trim(coalesce(CASE WHEN p.p_partkey % 2 = 1 THEN p.p_name END, trim(p.p_brand)))
              ELSE {norm('p.p_brand')} END AS name
  FROM clip c JOIN part p USING (p_partkey)
)
SELECT pieces.street_ref_id, pieces.street_key, pieces.name, last.arrondissement,
       CAST(last.median_price_m2 AS DOUBLE) AS metric_value,
       'street' AS map_level, 'Rues' AS level_label, 'median_price_m2' AS selected_metric, 'Prix median au m²' AS metric_label,
       'EUR/m²' AS metric_unit, true AS supports_year, CAST((SELECT max(year) FROM sy) AS INTEGER) AS metric_year
FROM pieces JOIN last USING (street_key)""",

    "q27_map_building": f"""WITH {MICRO_CTE},
b AS (SELECT {BUILDING_KEYS}, median(longitude) AS longitude, median(latitude) AS latitude,
             {r('median(built_surface_m2)')} AS median_surface_m2 FROM micro GROUP BY {BUILDING_KEYS})
SELECT building_id, coalesce(nullif(building_label, ''), building_id) AS name, longitude, latitude,
       CAST(median_surface_m2 AS DOUBLE) AS metric_value,
       'building' AS map_level, 'Batiments' AS level_label, 'median_surface_m2' AS selected_metric, 'Surface mediane' AS metric_label,
       'm²' AS metric_unit, true AS supports_year, CAST((SELECT max(year) FROM b) AS INTEGER) AS metric_year
FROM b WHERE year = (SELECT max(year) FROM b) AND longitude IS NOT NULL AND latitude IS NOT NULL""",

    "q28_legend_stops": f"""WITH {overview_sql(LATEST)},
v AS (SELECT coalesce(CAST(median_price_m2 AS DOUBLE), 0.0::DOUBLE) AS v FROM overview),
s AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, list_sort(list(v)) AS l FROM v)
SELECT CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE lo END AS stop_low,
       CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN lo = hi THEN lo + 1 ELSE l[n // 2 + 1] END AS stop_mid,
       CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN lo = hi THEN lo + 2 ELSE hi END AS stop_high
FROM s""",

    "q37_metadata": f"""WITH {SALES_CTE}, {RENT_CTE}, {SOCIAL_CTE},
cat(metric, label, unit, supports_year, pos) AS (VALUES {', '.join(f"('{m}', '{l}', '{u}', {str(y).lower()}, {i})" for i, (m, l, u, y) in enumerate(CATALOG_ROWS))}),
lv(level, level_label, micro) AS (VALUES {', '.join(f"('{k}', '{lab}', {'false' if n is None else 'true'})" for k, lab, n in LEVEL_ROWS)})
SELECT lv.level, lv.level_label, cat.metric, cat.label, cat.unit, cat.supports_year,
       (SELECT max(year) FROM sales) AS latest_sales_year,
       (SELECT max(year) FROM social) AS latest_social_year,
       (SELECT max(year) FROM rent) AS latest_rent_year,
       (SELECT string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FROM sales) AS available_sales_years,
       (SELECT string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FROM social) AS available_social_years,
       (SELECT string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) FROM rent) AS available_rent_years
FROM lv JOIN cat ON NOT lv.micro OR cat.metric IN {MICRO}""",
})


ORACLE["q29_coverage"] = f"""WITH {GEOCODE_CTE}, {OCTAGON_CTE},
g AS (
  SELECT *, coalesce(nullif(label0, ''), building_id) AS building_label,
         commune_insee || '|' || street_name AS street_key
  FROM geo
),
loc AS ({locate_sql('g', 'g_longitude', 'g_latitude')}),
edges_all AS (SELECT * FROM edges),
gq AS (SELECT g.*, loc.k AS quartier_id FROM g LEFT JOIN loc ON g.g_longitude = loc.px AND g.g_latitude = loc.py),
iris_edges AS (SELECT e.* FROM edges e JOIN nation n ON n.n_nationkey = e.k ),
iloc AS (
  SELECT px, py, min(k) FILTER (WHERE hit) AS k FROM (
    SELECT p.g_longitude AS px, p.g_latitude AS py, e.k,
           sum(CASE WHEN (e.y1 > p.g_latitude) <> (e.y2 > p.g_latitude)
                    THEN CASE WHEN p.g_longitude < e.x1 + (p.g_latitude - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
                              THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1
           OR bool_or((e.x2 - e.x1) * (p.g_latitude - e.y1) - (e.y2 - e.y1) * (p.g_longitude - e.x1) = 0
                      AND p.g_longitude BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2)
                      AND p.g_latitude BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2)) AS hit
    FROM (SELECT DISTINCT g_longitude, g_latitude FROM g WHERE g_longitude IS NOT NULL) p
    JOIN iris_edges e ON true GROUP BY 1, 2, 3) GROUP BY px, py
),
gi AS (SELECT gq.*, iloc.k AS iris_code FROM gq LEFT JOIN iloc ON gq.g_longitude = iloc.px AND gq.g_latitude = iloc.py),
streets AS (SELECT DISTINCT {STREET_KEYS} FROM g WHERE street_name <> ''),
buildings AS (SELECT DISTINCT {BUILDING_KEYS} FROM g WHERE building_id IS NOT NULL)
SELECT count(*) AS input_rows, count(DISTINCT transaction_id) AS input_transactions,
       count(*) FILTER (WHERE geocode_source = 'adresses-ban') AS adresses_ban_rows,
       count(*) FILTER (WHERE geocode_source = 'ban-plus') AS ban_plus_rows,
       count(*) FILTER (WHERE g_longitude IS NOT NULL) AS geocoded_rows,
       count(*) FILTER (WHERE quartier_id IS NOT NULL) AS quartier_rows,
       count(*) FILTER (WHERE iris_code IS NOT NULL) AS iris_rows,
       (SELECT count(DISTINCT street_key) FROM streets) AS street_count,
       (SELECT count(*) FROM streets) AS street_year_rows,
       (SELECT count(DISTINCT building_id) FROM buildings) AS building_count,
       (SELECT count(*) FROM buildings) AS building_year_rows,
       {r('count(*) FILTER (WHERE g_longitude IS NOT NULL) * 100.0::DOUBLE / count(*)')} AS geocoded_rate_pct
FROM gi"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold_sql(expr: str) -> str:
    """DuckDB twin of normalize_text for texts whose folded characters are accented letters."""
    out = f"regexp_replace(strip_accents(coalesce({expr}, '')), '[^\\x00-\\x7F]', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(upper({out}), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"




def street_sql(expr: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STREET_ALIASES.items())
    return f"array_to_string(list_transform(string_split({norm(expr)}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def digits(expr: str) -> str:
    return f"regexp_replace(coalesce({expr}, ''), '[^0-9]', '', 'g')"


def zfill(expr: str, n: int) -> str:
    return f"CASE WHEN length({expr}) < {n} THEN lpad({expr}, {n}, '0') ELSE {expr} END"


def _lambert_sql() -> tuple[str, str]:
    """Published form: isometric latitude, then x = Xs + C exp(-n L) sin(theta), y = Ys - C exp(-n L) cos(theta)."""
    num = lambda v: f"{v}::DOUBLE"
    phi, e, n = "radians(lat)", num(GRS80_E), num(LAMBERT_N)
    iso = f"(ln(tan(pi() / 4 + {phi} / 2)) - {e} / 2 * ln((1 + {e} * sin({phi})) / (1 - {e} * sin({phi}))))"
    radius, theta = f"({num(LAMBERT_C)} * exp(-{n} * {iso}))", f"({n} * radians(lon - 3.0::DOUBLE))"
    return (f"{num(LAMBERT_XS)} + {radius} * sin({theta})", f"{num(LAMBERT_YS)} - {radius} * cos({theta})")


_LX, _LY = _lambert_sql()
_PREFIX = digits("prefix")
_NUM = digits("numero")

KEYS_CTE = f"""
raw AS (
  SELECT p_partkey, '75' AS dep,
         CASE WHEN p_size % 10 <> 0 THEN CAST(p_size % 25 AS VARCHAR) END AS commune,
         CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey % 1000 AS VARCHAR) END AS prefix,
         lower(substring(p_brand, 7, 2)) || ' ' || substring(p_type, 1, 1) AS section,
         CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS plan,
         lpad(CAST(p_size AS VARCHAR), 4, '0') AS numero,
         CASE WHEN p_type = 'STANDARD' THEN 'b' WHEN p_type = 'PROMO' THEN 'Q' END AS btq,
         CASE WHEN p_size % 2 = 0 THEN 'AV' ELSE 'BD' END AS tv, p_name AS voie,
         '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS dm,
         replace(CAST(p_retailprice AS VARCHAR), '.', ',') AS vf, p_type AS tl,
         CAST(p_size AS VARCHAR) AS surf
  FROM part
),
k1 AS (
  SELECT *, {digits('dep')} AS dep_d, {zfill(digits('commune'), 3)} AS commune3,
         {zfill(f"CASE WHEN {_PREFIX} = '' THEN '000' ELSE {_PREFIX} END", 3)} AS prefix3,
         replace(upper(coalesce(section, '')), ' ', '') AS section_c, {digits('plan')} AS plan_d,
         CASE WHEN ltrim({_NUM}, '0') = '' THEN {_NUM} ELSE ltrim({_NUM}, '0') END AS house_number,
         CASE WHEN btq IS NULL THEN '' ELSE
           CASE {norm('btq')} WHEN 'B' THEN 'BIS' WHEN 'BIS' THEN 'BIS' WHEN 'T' THEN 'TER' WHEN 'TER' THEN 'TER'
                WHEN 'Q' THEN 'QUATER' WHEN 'QUATER' THEN 'QUATER' ELSE {norm('btq')} END END AS house_suffix,
         {street_sql("concat_ws(' ', coalesce(tv, ''), coalesce(voie, ''))")} AS street_name
  FROM raw
),
k2 AS (
  SELECT *, dep_d || commune3 AS commune_insee,
         CASE WHEN dep_d = '' OR commune3 = '' OR section_c = '' OR plan_d = '' THEN NULL
              ELSE dep_d || commune3 || prefix3 || section_c || {zfill('plan_d', 4)} END AS parcel_id
  FROM k1
),
k3 AS (
  SELECT *, concat_ws('|', commune_insee, house_number, house_suffix, street_name) AS address_key,
         concat_ws('|', commune_insee, house_number, street_name) AS address_key_no_suffix,
         concat_ws('|', coalesce(dm, ''), coalesce(vf, ''), coalesce(parcel_id, ''), house_number,
                   street_name, coalesce(tl, ''), coalesce(surf, '')) AS transaction_id,
         CASE WHEN street_name <> '' THEN commune_insee || '|' || street_name END AS street_key
  FROM k2
),
k4 AS (
  SELECT *, coalesce(nullif(parcel_id, ''), nullif(address_key, '')) AS building_id,
         CASE WHEN nullif(parcel_id, '') IS NOT NULL THEN 'parcel'
              WHEN nullif(address_key, '') IS NOT NULL THEN 'address_key' END AS building_id_source,
         trim(regexp_replace(house_number || ' ' || house_suffix || ' ' || street_name, '\\s+', ' ', 'g')) AS label0
  FROM k3
)"""

_RAW_STREET = """array_to_string(list_filter([
    trim(coalesce(CASE WHEN p_size % 4 = 0 THEN 'AV' WHEN p_size % 4 = 1 THEN 'bd' WHEN p_size % 4 = 2 THEN ' Pl ' END, '')),
    trim(CASE WHEN p_size % 3 = 0 THEN 'de l''' ELSE '' END),
    trim(coalesce(p_name, ''))], lambda x: x <> ''), ' ')"""

ORACLE.update({
    "q30_text_normalise": f"SELECT doc_id, {fold_sql('text')} AS normalized FROM documents",
    "q31_street_alias": f"""WITH raw AS (SELECT p_partkey, {_RAW_STREET} AS raw_name FROM part)
SELECT p_partkey, raw_name, {street_sql('raw_name')} AS street_name FROM raw""",
    "q32_french_number": """SELECT c_custkey,
       CASE WHEN c_custkey % 17 = 0 OR c_custkey % 19 = 0 THEN NULL ELSE c_acctbal END AS amount
FROM customer""",
    "q33_postal_district": f"""WITH pc AS (
  SELECT c_custkey, c_nationkey,
         CASE WHEN c_custkey % 7 = 0 THEN '75116'
              WHEN c_custkey % 7 = 1 THEN '75 0' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')
              WHEN c_custkey % 7 = 2 THEN '690' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0')
              WHEN c_custkey % 7 = 4 THEN 'abc'
              WHEN c_custkey % 7 <> 3 THEN '750' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 2, '0') END AS code
  FROM customer),
d AS (SELECT *, {digits('code')} AS dg FROM pc)
SELECT c_custkey,
       CAST(CASE WHEN code IS NULL OR dg = '' THEN NULL WHEN dg = '75116' THEN 16
            WHEN dg LIKE '75%' AND length(dg) >= 5 AND TRY_CAST(right(dg, 2) AS INTEGER) BETWEEN 1 AND 20
            THEN TRY_CAST(right(dg, 2) AS INTEGER) END AS INTEGER) AS district,
       dg AS digits, CAST(c_nationkey + 1 AS INTEGER) AS block_district
FROM d""",
    "q34_keys": f"""WITH {KEYS_CTE}
SELECT commune_insee, parcel_id, house_number, house_suffix, street_name, address_key,
       address_key_no_suffix, transaction_id, street_key, building_id, building_id_source,
       coalesce(nullif(label0, ''), building_id) AS building_label
FROM k4""",
    "q35_lambert93": f"""WITH pts AS (
  SELECT n_nationkey, 2.2::DOUBLE + n_nationkey / 100.0::DOUBLE AS lon,
         48.8::DOUBLE + n_nationkey / 200.0::DOUBLE AS lat
  FROM nation)
SELECT n_nationkey, {r(_LX, 3)} AS x, {r(_LY, 3)} AS y FROM pts""",
})

ORACLE.update({
    "q36_geojson_roundtrip": f"""SELECT CAST(n_nationkey + 1 AS INTEGER) AS arrondissement, n_name AS name,
       CAST(n_nationkey + 1 AS VARCHAR) || 'e' AS label, CAST(75101 + n_nationkey AS INTEGER) AS insee_code,
       '75' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS postal_code,
       {r('0.875::DOUBLE')} AS surface_m2, 8 AS n_edges
FROM nation""",
    "q38_filtered_ingest": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, strftime(o_orderdate, '%d/%m/%Y') AS date_mutation,
       o_totalprice AS sale_value_eur, CAST(o_custkey % 200 AS DOUBLE) AS built_surface_m2,
       CAST(c_nationkey + 1 AS INTEGER) AS arrondissement,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Appartement' ELSE 'Maison' END AS property_type,
       '75' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 3, '0') AS commune_insee,
       '75' || lpad(CAST(c_nationkey + 1 AS VARCHAR), 3, '0') || '000AB'
         || lpad(CAST(o_orderkey % 9999 AS VARCHAR), 4, '0') AS parcel_id
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_nationkey % 5 = 2 AND c_nationkey < 20 AND year(o_orderdate) BETWEEN 2000 AND 2099
  AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_custkey % 200 > 10 AND o_totalprice > 10000
  AND o_totalprice / (o_custkey % 200) BETWEEN 1000 AND 50000""",
    "q39_gold_sinks": ORACLE["q01_sales_district_year"],
})


ORACLE["q41_overview_city"] = f"""WITH {overview_sql('1998')}
{CITY_SQL.replace('FROM summary', 'FROM overview')[:-len('FROM overview')]}, CAST(1998 AS INTEGER) AS selected_sales_year
FROM overview"""


ORACLE.update({
    "q42_sales_block_year": f"""WITH {SALES_CTE}, {OCTAGON_CTE},
loc AS ({locate_sql('sales', 'longitude', 'latitude')}),
b AS (
  SELECT s.* EXCLUDE (arrondissement), CAST(loc.k AS VARCHAR) AS iris_code, n.n_name AS iris_name,
         'T' || n.n_regionkey AS iris_type, CAST(loc.k + 1 AS INTEGER) AS arrondissement
  FROM sales s JOIN loc ON s.longitude = loc.px AND s.latitude = loc.py JOIN nation n ON n.n_nationkey = loc.k
)
SELECT iris_code, iris_name, iris_type, arrondissement, year, {metric_block()}
FROM b GROUP BY iris_code, iris_name, iris_type, arrondissement, year""",
    "q43_address_file": f"""WITH {REF_CTE}
SELECT cle_interop, commune_insee, house_number, house_suffix, street_name, long, lat, certification FROM ref""",
    "q44_income_file": ORACLE["q05_income_by_district"],
    "q45_rent_file": ORACLE["q06_rent_by_district_year"],
    "q46_social_file": ORACLE["q07_social_by_district_year"],
    "q47_quarter_layer": """SELECT '751' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '01' AS quartier_id,
       CAST(n_nationkey + 1 AS INTEGER) AS quartier_code, CAST(n_nationkey + 1 AS INTEGER) AS arrondissement,
       n_name AS name, 0.88::DOUBLE AS surface_m2, 3.41::DOUBLE AS perimeter_m, 'Polygon' AS geometry_type FROM nation""",
    "q48_block_file": """SELECT '751' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '0101' AS iris_code, n_name AS iris_name,
       'T' || n_regionkey AS iris_type, CAST(n_nationkey + 1 AS INTEGER) AS arrondissement,
       '751' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') AS commune_insee, 8 AS n_edges
FROM nation WHERE n_regionkey <> 0""",
    "q49_cell_file": ORACLE["q16_weighted_exposure"],
    "q50_link_batches": f"""WITH {LINKS_CTE},
one AS (
  SELECT idu, id_adr, type_lien, nb_adr, nb_parc, seq FROM links
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), o_orderpriority, NULL, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR),
         CAST(o_orderkey AS VARCHAR), (SELECT max(seq) FROM links) + 1 + o_orderkey FROM orders
),
two AS (
  SELECT * FROM one
  UNION ALL
  SELECT CAST(o_custkey AS VARCHAR), '', NULL, '0', CAST(o_orderkey AS VARCHAR), (SELECT max(seq) FROM one) + 1 + o_orderkey
  FROM orders
)
SELECT idu, id_adr, type_lien, first(nb_adr ORDER BY seq DESC) AS nb_adr,
       first(nb_parc ORDER BY seq DESC) AS nb_parc, max(seq) AS seq
FROM two GROUP BY idu, id_adr, type_lien""",
})


# order of the written table: by bytes, NULLs first
ORACLE["q51_gold_in_order"] = f"""SELECT
  row_number() OVER (ORDER BY {', '.join(f'{c.strip()} ASC NULLS FIRST' for c in STREET_KEYS.split(','))}) AS position,
  {STREET_KEYS}, transactions, median_price_m2
FROM ({ORACLE["q03_sales_street_year"]})"""
