"""Request texts to coordinates, and places around incidents and hotspots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions import text as T
from ..functions.geo import haversine_km
from . import stats
from .distance_join import counts_within, in_reach, nearest_k, together, within_box, within_distance
from ..session import stored
from .skew import salted_join

#: Keys of one coordinate in a list, and places in a block.
PER_LIST, PER_BLOCK = 50_000, 500
#: Pairs in reach of a block's keys, and of those of a task, up to a number of tasks.
PER_UNROLLED, PER_TASK, MOST_TASKS = 1_000_000, 10_000_000, 10_000


def gazetteer_index(gazetteer: DataFrame) -> DataFrame:
    """One entry per place name: its coordinates and city code."""
    city = T.city_of_address(gazetteer.columns)
    entry = F.struct("lat", "lon", city.alias("city"))
    return gazetteer.groupBy(T.place_key(F.col("place")).alias("place_key")).agg(
        F.min(entry).alias("entry"))


def coordinates_of(texts: DataFrame, gazetteer: DataFrame, text: str = "message",
                   key: str = "loc_id") -> DataFrame:
    """(key, lat, lon, city, source) of texts that name coordinates or a known place.

    Direct coordinates come first, then the text without its business word, then the part after the
    first comma. Texts that give nothing keep null coordinates.
    """
    t = F.col(text)
    tries = texts.select(
        key, T.direct_coordinates(t).alias("direct"),
        T.place_key(T.without_business_word(t)).alias("k1"),
        T.place_key(T.without_business_word(T.after_comma(t))).alias("k2"))
    index = gazetteer_index(gazetteer)
    found = (tries.join(index.withColumnsRenamed({"place_key": "k1", "entry": "e1"}), "k1", "left")
             .join(index.withColumnsRenamed({"place_key": "k2", "entry": "e2"}), "k2", "left"))
    pick = F.coalesce("e1", "e2")
    direct = F.col("direct").isNotNull()
    lat = F.coalesce("direct.lat", pick["lat"])
    lon = F.coalesce("direct.lon", pick["lon"])
    city = F.when(direct, T.city_of_coordinates(F.col("direct.lat"), F.col("direct.lon"))
                  ).otherwise(pick["city"])
    return found.select(
        key, lat.alias("lat"), lon.alias("lon"),
        F.when(lat.isNotNull(), F.coalesce(city, F.lit("unknown"))).alias("city"),
        F.when(direct, "direct").when(F.col("e1").isNotNull(), "text")
        .when(F.col("e2").isNotNull(), "address").alias("source"))


def places_near(incidents: DataFrame, places: DataFrame, km: float,
                key: str = "incident_id", ordered: bool = False) -> DataFrame:
    """(incident, place) pairs with the distance in metres to one decimal, both positions kept.

    Incidents at one coordinate are searched once; the lists of their keys and of the places near them meet last.
    With `ordered`, rows come by crime_lat, crime_lon and distance: lists are put in order and unrolled in place.
    """
    at = ["crime_lat", "crime_lon"]
    where = incidents.select(key, F.col("latitude").alias("crime_lat"), F.col("longitude").alias("crime_lon"))
    lists = together(where, *at, PER_LIST).select(
        F.col("_lat").alias("crime_lat"), F.col("_lon").alias("crime_lon"), F.col(f"_rows.{key}").alias("_keys"))
    if ordered:
        return _unrolled_in_order(stored(lists.withColumn("_list", F.monotonically_increasing_id())), places, km, key)
    lists = stored(lists)
    pairs = within_distance(places, lists.select(*at).distinct(), km, "latitude", "longitude", *at).withColumn(
        "distance_meters", C.round_half_up(F.col("distance") * 1000, 1)).drop("distance")
    names = [c for c in pairs.columns if c not in at]
    return pairs.join(lists, at).select(F.explode("_keys").alias(key), *at, *names)


def _unrolled_in_order(lists: DataFrame, places: DataFrame, km: float, key: str) -> DataFrame:
    """Pairs of the keys in `lists` (crime_lat, crime_lon, _keys, _list), by crime_lat, crime_lon and distance.

    What a coordinate's list will be unrolled to is known from its keys and the places in the cells around it.
    Coordinates are dealt in order to as many tasks as that takes, in blocks of a limited number of pairs, each for
    its share of the places by distance. Blocks stay where they are from there on: a short table of places comes to
    them, and neither pairs nor lists of places are shuffled.
    """
    at, spot = ["crime_lat", "crime_lon"], ["crime_lat", "crime_lon", "_block", "_list"]
    spots = lists.groupBy(*at).agg(F.count("*").alias("_lists"))
    reach = stored(in_reach(spots, places, km, *at).groupBy(*at, "_lists").agg(F.sum("_n").alias("_reach")))
    sized = lists.join(reach, at).withColumn("_pairs", F.size("_keys") * F.col("_reach"))
    total = sized.agg(F.sum("_pairs")).first()[0] or 0
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(
        total // PER_TASK, MOST_TASKS))
    # Where the keys of a coordinate are several lists, its places stand alone, so that the lists can alternate.
    blocks = F.when(F.col("_lists") > 1, F.col("_reach")).otherwise(F.ceil(F.greatest(
        F.col("_reach") / PER_BLOCK, F.col("_pairs") / PER_UNROLLED)))
    sites = sized.select(*at, "_list", "_keys", blocks.alias("_blocks")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).repartitionByRange(tasks, *spot)
    pairs = within_distance(sites, places, km, *at, "latitude", "longitude", in_place=True, apart=["_keys"]).withColumn(
        "distance_meters", C.round_half_up(F.col("distance") * 1000, 1))
    place = F.struct("distance_meters", *places.columns)
    # The places near one coordinate.
    near = pairs.groupBy(*spot, "_blocks").agg(
        F.first("_keys", ignorenulls=True).alias("_keys"),
        F.sort_array(F.collect_list(F.when(F.col("distance").isNotNull(), place))).alias("_places"))
    upto = [F.floor(F.size("_places") * (F.col("_block") + k) / F.col("_blocks")).cast("int") for k in (0, 1)]
    rows = near.select(*spot, "_keys", F.slice("_places", upto[0] + 1, upto[1] - upto[0]).alias("_places")).orderBy(*spot)
    return rows.select(*at, F.inline("_places"), "_keys").select(
        F.explode("_keys").alias(key), *at, "distance_meters", *places.columns)


def nearest_places_per_type(incidents: DataFrame, places: DataFrame,
                            km: float = rules.INCIDENT_POI_KM, most: int = rules.POIS_PER_TYPE,
                            key: str = "incident_id") -> DataFrame:
    """At most three places of each type close to each incident, by distance in decimetres, then name."""
    metres = C.round_half_up(F.col("distance") * 1000, 1)
    where = incidents.select(key, F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    found = nearest_k(where, places, most, km, "type", order=[metres, "name"], slack_km=1e-4, lat="_lat",
                      lon="_lon").withColumn("distance_meters", metres).drop("distance")
    return salted_join(where, found, ["_lat", "_lon"], [key]).withColumnsRenamed(
        {"_lat": "crime_lat", "_lon": "crime_lon"})


def places_with_fallback(incidents: DataFrame, places: DataFrame, km: float,
                         box_degrees: float = rules.FALLBACK_BOX_DEG,
                         key: str = "incident_id") -> DataFrame:
    """Places within `km`; incidents without any get those in a small box around them.

    Both searches run on distinct incident coordinates and are then given to the incidents there.
    """
    spots = incidents.select("latitude", "longitude").distinct().select(
        F.concat_ws(",", "latitude", "longitude").alias("spot"), "latitude", "longitude")
    near = places_near(spots, places, km, "spot").withColumn("method", F.lit("radius"))
    rest = spots.join(near.select("spot").distinct(), "spot", "left_anti").select(
        "spot", F.col("latitude").alias("crime_lat"), F.col("longitude").alias("crime_lon"))
    metres = haversine_km(F.col("crime_lat"), F.col("crime_lon"), F.col("latitude"),
                          F.col("longitude")) * 1000
    boxed = within_box(places, rest, box_degrees, "latitude", "longitude", "crime_lat",
                       "crime_lon").withColumns({
        "distance_meters": C.round_half_up(metres, 1), "method": F.lit("box")})
    names = ["crime_lat", "crime_lon", "name", "type", "distance_meters", "method"]
    found = near.select(*names).unionByName(boxed.select(*names))
    where = incidents.select(key, F.col("latitude").alias("crime_lat"),
                             F.col("longitude").alias("crime_lon"))
    return salted_join(where, found, ["crime_lat", "crime_lon"], [key]).select(
        key, "name", "type", "distance_meters", "method")


def amenities_of_top_hotspots(hotspots: DataFrame, amenities: DataFrame, top: int = 10,
                              km: float = rules.HOTSPOT_POI_KM) -> DataFrame:
    """Amenity counts by type around the largest hotspots; an empty map where there are none."""
    largest = hotspots.orderBy(F.desc("crime_count"), "cluster").limit(top)
    counts = counts_within(largest, amenities, km, ["type"], key="cluster", lat="latitude",
                           lon="longitude").groupBy("cluster").agg(
        stats.sorted_counts("type", "n").alias("top_amenities"))
    empty = F.create_map().cast("map<string,bigint>")
    return largest.select("cluster", "crime_count").join(counts, "cluster", "left").withColumn(
        "top_amenities", F.coalesce("top_amenities", empty))


def retirement_contingency(hotspots: DataFrame, elderly: DataFrame, amenities: DataFrame,
                           top: int = 5, km: float = rules.HOTSPOT_POI_KM) -> DataFrame:
    """2×2 table of the hotspots with most elderly victims, with corrected chi-square.

    Retirement home within `km`, against an elderly count above the median of those hotspots.
    """
    largest = elderly.orderBy(F.desc("count"), "cluster").limit(top)
    placed = hotspots.join(largest, "cluster").select("cluster", "latitude", "longitude", "count")
    homes = amenities.filter(F.col("type").isin(rules.RETIREMENT_TYPES))
    near = counts_within(placed, homes, km, key="cluster", lat="latitude", lon="longitude")
    median = largest.agg(F.percentile("count", F.lit(0.5))).scalar()
    flags = placed.join(near, "cluster", "left").select(
        F.col("n").isNotNull().alias("home"), (F.col("count") > median).alias("high"))
    home, high = F.col("home"), F.col("high")
    table = flags.agg(
        F.count_if(home & high).alias("home_high"), F.count_if(home & ~high).alias("home_low"),
        F.count_if(~home & high).alias("none_high"), F.count_if(~home & ~high).alias("none_low"))
    chi = stats.yates_chi_square(*[F.col(c) for c in (
        "home_high", "home_low", "none_high", "none_low")])
    return table.withColumn("chi_square", chi).withColumn(
        "p_value", stats.chi_square_tail(F.col("chi_square")))
