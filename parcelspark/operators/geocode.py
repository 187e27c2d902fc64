"""Geocoding: address reference dedupe, the three-tier lookup cascade and parcel links.

Scale notes
- The address reference and the link table are deduplicated to one row per key *before* any
  join, so no join fans out.
- Each fallback tier joins only the rows still lacking coordinates; matched rows skip later tiers.
- Lookups are plain left equi joins: AQE broadcasts a side only when its measured size is under
  ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, splitting skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes, numeric, text
from ..session import materialize
from .quantile import exact_medians

# ---- fixed values (domain rules of the reference pipeline) ---------------------------------
SOURCE_ADDRESS = "adresses-ban"      # geocode source of tiers 1 and 2
SOURCE_LINK = "ban-plus"             # geocode source of tier 3
LINK_PRIORITY = {"GEO": 0, "BAN": 1}  # any other link type ranks 9
LINK_OTHER_PRIORITY = 9
LINK_MISSING_COUNT = 999999           # address count used when it is missing
CITY_INSEE_PREFIX = "751"
# ---------------------------------------------------------------------------------------------


def prepare_address_reference(raw: DataFrame) -> DataFrame:
    """Raw address rows (cle_interop, commune_insee, voie_nom, numero, suffixe, long, lat,
    certification_commune as text) -> normalised rows with both address keys; rows outside
    the city or without coordinates are dropped."""
    c = F.col
    data = raw.where(c("commune_insee").startswith(CITY_INSEE_PREFIX)).select(
        "cle_interop", "commune_insee",
        text.normalize_street_name(c("voie_nom")).alias("street_name"),
        text.normalize_house_number(c("numero")).alias("house_number"),
        text.normalize_house_suffix(c("suffixe")).alias("house_suffix"),
        numeric.parse_number(c("long")).alias("long"),
        numeric.parse_number(c("lat")).alias("lat"),
        F.coalesce(numeric.parse_number(c("certification_commune")), F.lit(0.0)).alias("certification"))
    data = data.where(c("long").isNotNull() & c("lat").isNotNull())
    return data.select(
        "*",
        codes.pipe_key("commune_insee", "house_number", "house_suffix", "street_name").alias("address_key"),
        codes.pipe_key("commune_insee", "house_number", "street_name").alias("address_key_no_suffix"))


def dedupe_reference(ref: DataFrame, key: str, *, id_col: str = "cle_interop",
                     rank_col: str = "certification", lon: str = "long", lat: str = "lat") -> DataFrame:
    """One row per key: id of the best row (highest certification, then smallest id; first
    non-null id), exact median longitude and latitude over all rows of the key."""
    keyed = ref.where(F.col(key).isNotNull()).withColumn("lookup_key", F.col(key))
    order = F.struct((-F.col(rank_col)).alias("r"), F.col(id_col).alias("i"))
    best = keyed.where(F.col(id_col).isNotNull()).groupBy("lookup_key").agg(
        F.min_by(F.col(id_col), order).alias("_best"))
    med = exact_medians(keyed, ["lookup_key"], {"long": lon, "lat": lat})
    return med.join(best, "lookup_key", "left").select(
        "lookup_key", F.col("_best").alias("cle_interop"), "long", "lat")


def best_links(links: DataFrame) -> DataFrame:
    """Best address link per parcel: non-empty address id, then priority (GEO, BAN, other),
    address count ascending (missing last), address id ascending. ``type_lien`` is the first
    non-null value in that order, independently of ``id_adr`` (pandas groupby ``first``). Links
    without a parcel id are left out."""
    prio = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LINK_PRIORITY.items() for x in kv]),
                                       F.col("type_lien")), F.lit(LINK_OTHER_PRIORITY))
    nb = F.coalesce(numeric.parse_number(F.col("nb_adr")), F.lit(float(LINK_MISSING_COUNT)))
    valid = (links.where(F.col("idu").isNotNull() & F.col("id_adr").isNotNull() & (F.col("id_adr") != ""))
                  .withColumn("_order", F.struct(prio.alias("p"), nb.alias("n"), F.col("id_adr").alias("a"))))
    return valid.groupBy("idu").agg(
        F.min_by("id_adr", "_order").alias("id_adr"),
        F.min_by(F.col("type_lien"), F.when(F.col("type_lien").isNotNull(), F.col("_order")))
         .alias("type_lien"))


def missing_link_ids(parcel_ids: DataFrame, links: DataFrame, col: str = "parcel_id") -> DataFrame:
    """Distinct non-empty parcel ids not yet present in the link table (a stored empty link
    counts as present: it is the negative cache). Left anti join, no collect."""
    wanted = parcel_ids.select(F.col(col).alias("idu")).where(
        F.col("idu").isNotNull() & (F.col("idu") != "")).distinct()
    known = links.select("idu").where(F.col("idu").isNotNull())
    return wanted.join(known, "idu", "left_anti")


def merge_links(existing: DataFrame, delivered: DataFrame, order_col: str = "seq") -> DataFrame:
    """Append a delivered batch to the link table; on duplicate (idu, id_adr, type_lien) the
    last row wins: delivered after existing, and inside a batch the higher ``order_col`` (the
    stored row order). The result keeps a row order in ``order_col`` (delivered rows continue after
    the stored ones), so it can be stored and merged again. A batch need not have an order: rows
    without one, or with NULL, come after the stored rows and before the ordered ones, and among
    themselves the largest (nb_adr, nb_parc) wins, so that reruns agree. NULL keys compare equal, as groups do.
    One aggregate with partial aggregation; no window over a whole key."""
    cols = ["idu", "id_adr", "type_lien", "nb_adr", "nb_parc"]
    after = F.coalesce(existing.agg(F.max(order_col)).scalar() + 1, F.lit(0)).cast("long")
    own = F.col(order_col).cast("long") if order_col in delivered.columns else F.lit(None).cast("long")
    # rows without an order stand right behind the stored ones; where there are any, the ordered ones follow them
    shift = delivered.agg(F.when(F.count_if(own.isNull()) > 0, 1).otherwise(0)).scalar()
    place = F.when(own.isNull(), after).otherwise(after + shift + own)
    both = (existing.select(*cols, F.coalesce(F.col(order_col).cast("long"), F.lit(-1).cast("long")).alias(order_col))
            .unionByName(delivered.select(*cols, place.alias(order_col))))
    last = F.struct(order_col, "nb_adr", "nb_parc")
    return (both.groupBy("idu", "id_adr", "type_lien")
                .agg(F.max(last).alias("_r"))
                .select("idu", "id_adr", "type_lien", "_r.nb_adr", "_r.nb_parc", f"_r.{order_col}"))


def geocode_cascade(sales: DataFrame, with_suffix: DataFrame, without_suffix: DataFrame,
                    by_interop: DataFrame, links: DataFrame | None) -> DataFrame:
    """Attach ``matched_cle_interop``, ``longitude``, ``latitude``, ``geocode_source``.

    The sales with tier 1 applied, and those still open after tier 2, are each materialised: both are read as
    matched and as unmatched rows, so the joins before them run once. Lookup tables are read once
    each.

    Tier 1: full address key; tier 2 (rows without coordinates): key without suffix; tier 3
    (still without coordinates, with a parcel): best link of the parcel -> address id ->
    coordinates. In tier 3 the id is kept even when it has no coordinates, and only rows that
    got coordinates are tagged with the link source.
    """
    def lookup(df, table, key):
        t = table.select(F.col("lookup_key").alias("_lk"), F.col("cle_interop").alias("_id"),
                         F.col("long").alias("_lon"), F.col("lat").alias("_lat"))
        return df.join(t, df[key] == t["_lk"], "left").drop("_lk")

    t1 = lookup(sales, with_suffix, "address_key")
    t1 = t1.select(*sales.columns, F.col("_id").alias("matched_cle_interop"),
                   F.col("_lon").alias("longitude"), F.col("_lat").alias("latitude"),
                   F.when(F.col("_id").isNotNull(), F.lit(SOURCE_ADDRESS)).alias("geocode_source"))
    out_cols = t1.columns
    t1 = materialize(t1)
    done1 = t1.where(F.col("longitude").isNotNull())
    rest1 = t1.where(F.col("longitude").isNull()).drop("matched_cle_interop", "longitude", "latitude")

    t2 = lookup(rest1, without_suffix, "address_key_no_suffix")
    t2 = t2.select(*[c for c in rest1.columns if c != "geocode_source"],
                   F.col("_id").alias("matched_cle_interop"),
                   F.col("_lon").alias("longitude"), F.col("_lat").alias("latitude"),
                   F.when(F.col("_id").isNotNull(), F.lit(SOURCE_ADDRESS))
                    .otherwise(F.col("geocode_source")).alias("geocode_source")).select(*out_cols)
    t2 = materialize(t2) if links is not None else t2
    if links is None:  # no link table: tier 3 cannot apply
        return done1.unionByName(t2)
    done2 = t2.where(F.col("longitude").isNotNull() | F.col("parcel_id").isNull())
    rest2 = t2.where(F.col("longitude").isNull() & F.col("parcel_id").isNotNull())

    best = best_links(links).select(F.col("idu").alias("_idu"), F.col("id_adr").alias("_adr"))
    # links get their coordinates before the join, so parcels without a link never share a NULL key
    best = lookup(best, by_interop, "_adr")
    t3 = rest2.join(best, rest2["parcel_id"] == best["_idu"], "left").drop("_idu")
    t3 = t3.select(*[c for c in rest2.columns if c not in ("matched_cle_interop", "longitude",
                                                           "latitude", "geocode_source")],
                   F.col("_adr").alias("matched_cle_interop"),
                   F.col("_lon").alias("longitude"), F.col("_lat").alias("latitude"),
                   F.when(F.col("_lon").isNotNull(), F.lit(SOURCE_LINK))
                    .otherwise(F.col("geocode_source")).alias("geocode_source")).select(*out_cols)
    # the tiers' partitions are of very unequal size, and later joins that are read where they were written keep that
    return done1.unionByName(done2).unionByName(t3).hint("rebalance")
