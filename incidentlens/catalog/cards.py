"""Scores, safety cards, reports and map layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules
from ..functions import text as T
from ..operators import density as D
from ..operators import distance_join as J
from ..operators import hotspots as H
from ..operators import layers, places, scoring, zones
from ..operators.risk import category_sums
from ..plans import safety_card as card
from ..plans.safety_card import Models
from ..session import stored
from ..sources import fixtures as fx
from .base import cases, contains, half_up, list_text, modal, quoted, sql
from .models import (
    _GRID, _PROFILES, _SCORE, _TOP3, NUMBERED, crime_zones, demographic_rows,
    demographic_zones, density, numbered_zones, zoned_by_model)
from .registry import query
from .statistics import AM_DIST, NEAR, NOW, as_text, quadrants, zoned


def _tenths(group, category):
    pairs = [((g, c), str(round(w * 10))) for g, ws in rules.GROUP_WEIGHTS.items()
             for c, w in ws.items() if w != 1.0]
    return cases(pairs, lambda gc: f"{group} = {quoted(gc[0])} AND {category} = {quoted(gc[1])}",
                 "10")


_SQUARE = ("CAST(floor(lat / 0.1::DOUBLE) AS BIGINT) || '_' || "
           "CAST(floor(lon / 0.1::DOUBLE) AS BIGINT)")
_BUCKETS = ", ".join(
    f"count(*) FILTER (occurred_at IS NOT NULL AND hour_of_day BETWEEN {a} AND {b}) AS {n}"
    for n, a, b in rules.TIME_BUCKETS)

# Locations with the score of their square, incidents around them, and the adjusted score.
_CORE = f"""{_TOP3},
z AS (SELECT zone, {_SCORE} AS v FROM zon GROUP BY 1),
l AS (SELECT loc.*, {_SQUARE} AS zone, coalesce(v, 50::DOUBLE) AS base
      FROM loc LEFT JOIN z ON z.zone = {_SQUARE}),
p AS (SELECT loc_id, inc.* FROM loc JOIN inc ON {NEAR}),
ty AS (SELECT loc_id, crime_type, count(*) AS c FROM p GROUP BY 1, 2),
ca AS (SELECT loc_id, crime_category, count(*) AS c FROM p GROUP BY 1, 2),
ad AS (SELECT loc_id, sum(c * ({_tenths('demographic_group', 'crime_category')} - 10)) / sum(c)
         AS shift, {list_text('crime_category', 'c')} AS crime_categories
       FROM ca JOIN l USING (loc_id) GROUP BY 1),
sc AS (SELECT l.*, crime_categories, CASE WHEN demographic_group <> 'general' AND shift IS NOT NULL
         THEN {half_up('greatest(0, least(100, base - shift))', 1)} ELSE {half_up('base', 1)} END
         AS safety_score, {half_up('base', 1)} AS base_safety_score
       FROM l LEFT JOIN ad USING (loc_id)),
tm AS (SELECT loc_id, count(*) AS nearby, {_BUCKETS}, count(*) FILTER (occurred_at >=
         TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS total_recent FROM p GROUP BY 1),
pk AS (SELECT loc_id, nearby, morning, afternoon, evening, night, total_recent,
         greatest(morning, afternoon, evening, night) AS m,
         morning + afternoon + evening + night AS total FROM tm),
pb AS (SELECT *, CASE WHEN total > 0 THEN CASE WHEN m = morning THEN 'morning'
         WHEN m = afternoon THEN 'afternoon' WHEN m = evening THEN 'evening' ELSE 'night' END END
         AS peak FROM pk)"""
_LEVEL = cases([(b, quoted(n)) for b, n in rules.SAFETY_LEVELS],
               lambda b: f"safety_score >= {b}", quoted(rules.LOWEST_SAFETY_LEVEL))
_COLOUR = cases([(b, quoted(n)) for b, n in rules.SCORE_COLOURS],
                lambda b: f"safety_score > {b}", quoted(rules.LOWEST_SCORE_COLOUR))


def based(spark, d):
    """Locations with the score and offenses of their fixed square."""
    table = zones.zone_table(zoned(spark, d)).drop("crime_count")
    square = zones.grid_zone(F.col("lat"), F.col("lon"))
    return (fx.locations(spark, d).withColumn("zone", square).join(table, "zone", "left")
            .withColumn("base_score", F.coalesce("safety_score", F.lit(50.0)))
            .drop("safety_score"))


def core_cards(spark, d, now=NOW):
    return card.time_analysis(card.scored(card.nearby_summary(
        based(spark, d), fx.incidents(spark, d), now=now)))


@query("r1_group_weights", sql("inc", f"""@
w(demographic_group, crime_category, impact_weight) AS (VALUES {', '.join(
    f"({quoted(g)}, {quoted(c)}, {w!r}::DOUBLE)"
    for g, ws in rules.GROUP_WEIGHTS.items() for c, w in ws.items())})
SELECT demographic_group, crime_category, impact_weight, count(*) AS incidents
FROM inc JOIN w USING (crime_category) GROUP BY ALL"""))
def r1(spark, d):
    counts = fx.incidents(spark, d).groupBy("crime_category").agg(F.count("*").alias("incidents"))
    return scoring.group_weights(spark).join(counts, "crime_category")


@query("r2_adjusted_scores", sql("loc zon", f"""@{_CORE}
SELECT loc_id, demographic_group, round(base, 6) AS base_score, CASE WHEN
  demographic_group <> 'general' AND shift IS NOT NULL
  THEN {half_up('greatest(0, least(100, base - shift))', 1)} ELSE round(base, 6) END
  AS adjusted_score FROM l LEFT JOIN ad USING (loc_id)"""))
def r2(spark, d):
    where = based(spark, d).select("loc_id", "lat", "lon", "demographic_group", "base_score")
    counts = J.counts_within(where, fx.incidents(spark, d), rules.INCIDENT_RADIUS_KM,
                             sums=category_sums()).drop("n")
    return scoring.adjust_scores(where, counts).select(
        "loc_id", "demographic_group", F.round("base_score", 6).alias("base_score"),
        F.when(F.col("adjusted_score") == F.col("base_score"), F.round("base_score", 6))
        .otherwise(F.col("adjusted_score")).alias("adjusted_score"))


@query("r3_safety_card_core", sql("loc zon", f"""@{_CORE}
SELECT sc.loc_id AS loc_id, sc.zone AS zone, base_safety_score, safety_score, dominant_crime,
  common_crimes, coalesce(nearby, 0) AS nearby_crime_count, coalesce(t.types, '') AS crime_types,
  coalesce(crime_categories, '') AS crime_categories, coalesce(morning, 0) AS morning,
  coalesce(afternoon, 0) AS afternoon, coalesce(evening, 0) AS evening,
  coalesce(night, 0) AS night, coalesce(total_recent, 0) AS total_recent, peak,
  a.vic_age_group AS vic_age_group, b.vic_race AS vic_race, c.vic_sex AS vic_sex,
  {_LEVEL} AS safety_level, {_COLOUR} AS score_colour
FROM sc LEFT JOIN top USING (zone) LEFT JOIN pb USING (loc_id)
LEFT JOIN (SELECT loc_id, {list_text('crime_type', 'c')} AS types FROM ty GROUP BY 1) t
  USING (loc_id)
LEFT JOIN {modal('p', 'loc_id', 'vic_age_group')} a USING (loc_id)
LEFT JOIN {modal('p', 'loc_id', 'vic_race')} b USING (loc_id)
LEFT JOIN {modal('p', 'loc_id', 'vic_sex')} c USING (loc_id)"""))
def r3_core(spark, d):
    """Every part of the card that needs no fitted model, checked value by value."""
    score = F.col("safety_score")
    return core_cards(spark, d).select(
        "loc_id", "zone", "base_safety_score", "safety_score", "dominant_crime",
        as_text(F.col("common_crimes")).alias("common_crimes"), "nearby_crime_count",
        as_text(F.col("crime_types")).alias("crime_types"),
        as_text(F.col("crime_categories")).alias("crime_categories"),
        *[n for n, _, _ in rules.TIME_BUCKETS], "total_recent",
        F.col("peak.bucket").alias("peak"), *rules.DEMOGRAPHIC_COLUMNS,
        C.safety_level(score).alias("safety_level"), C.score_colour(score).alias("score_colour"))


def models(spark, d) -> Models:
    labelled = quadrants(spark, d)
    fitted = demographic_zones(spark, d)
    table = None if fitted is None else fx.kept(
        spark, d, "demographic-table",
        lambda: zones.demographic_zone_table(demographic_rows(spark, d)))
    return Models(
        zone_model=crime_zones(spark, d),
        zone_table=fx.kept(spark, d, "zone-table",
                           lambda: zones.zone_table(zoned_by_model(spark, d))),
        hotspot_points=fx.kept(spark, d, "hotspot-points", lambda: labelled.groupBy(
            "latitude", "longitude").agg(F.min("cluster").alias("cluster"))),
        hotspot_profiles=fx.kept(spark, d, "hotspot-profiles",
                                 lambda: H.cluster_profiles(labelled)),
        demographic_model=fitted, demographic_zones=table, density=density(spark, d))


def full_cards(spark, d):
    return card.safety_cards(fx.locations(spark, d), fx.incidents(spark, d),
                             fx.amenities(spark, d), models(spark, d), now=NOW)


@query("r3_safety_cards")
def r3(spark, d):
    """The whole card, nested sections as JSON."""
    df = full_cards(spark, d)
    nested = ["common_crimes", "crime_types", "crime_categories", "peak", "dbscan_cluster",
              "demographic_zone", "density", "amenities"]
    return df.withColumns({c: F.to_json(c) for c in nested if c in df.columns})


_AM = f"""
near AS (SELECT loc_id, am.*, {AM_DIST} AS dist FROM loc JOIN am ON {AM_DIST} <= 3),
kinds AS (SELECT loc_id, type, count(*) AS c, arg_min(name, (dist, name)) AS closest,
  {half_up('min(dist)', 2)} AS km FROM near GROUP BY 1, 2),
acard AS (SELECT loc_id, CAST(sum(c) AS BIGINT) AS nearby_count, {list_text('type', 'c')}
  AS type_counts, string_agg(type || ':' || closest || '@' || km, '; ' ORDER BY type) AS closest
  FROM kinds GROUP BY 1)"""


def _closest(items):
    return F.array_join(F.transform(items, lambda x: F.concat(
        x["type"], F.lit(":"), x["name"], F.lit("@"), x["distance_km"].cast("string"))), "; ")


@query("r4_amenity_cards_within_1km", sql("loc am", f"""@{_AM.replace("<= 3", "<= 1")}
SELECT loc_id, coalesce(nearby_count, 0) AS nearby_count, type_counts, closest
FROM loc LEFT JOIN acard USING (loc_id)"""))
def r4_near(spark, d):
    cards = scoring.amenity_cards(fx.locations(spark, d), fx.amenities(spark, d))
    return cards.select("loc_id", "nearby_count", as_text(F.col("type_counts"))
                        .alias("type_counts"), _closest(F.col("closest")).alias("closest"))


@query("r4_amenity_cards", sql("loc am", f"""@{_AM}
SELECT loc_id, coalesce(nearby_count, 0) AS nearby_count, type_counts, closest
FROM loc LEFT JOIN acard USING (loc_id)"""))
def r4(spark, d):
    cards = scoring.amenity_cards(fx.locations(spark, d), fx.amenities(spark, d), 3.0)
    return cards.select("loc_id", "nearby_count", as_text(F.col("type_counts"))
                        .alias("type_counts"), _closest(F.col("closest")).alias("closest"))


# --- map layers -----------------------------------------------------------------------------

@query("r6_density_layer", sql("inc", f"""@{_GRID}
SELECT 'node' AS kind, round(lat, 6) AS lat, round(lon, 6) AS lon, round(density, 6) AS density,
  classification FROM grid
UNION ALL SELECT 'low_max', NULL, NULL, round(low_max, 6), NULL FROM lim
UNION ALL SELECT 'medium_max', NULL, NULL, round(medium_max, 6), NULL FROM lim"""))
def r6(spark, d):
    """Grid nodes with their class, and the two thresholds."""
    grid = density(spark, d)
    nodes = layers.density_layer(grid).withColumn("kind", F.lit("node"))
    limits = D.thresholds(grid).select(F.expr(
        "stack(2, 'low_max', low_max, 'medium_max', medium_max) AS (kind, density)"))
    both = nodes.unionByName(limits, allowMissingColumns=True)
    return both.select("kind", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
                       F.round("density", 6).alias("density"), "classification")


@query("r7_hotspot_list", sql("quad", """
SELECT cluster AS id, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon,
  count(*) AS crime_count FROM quad WHERE cluster <> -1 GROUP BY 1"""))
def r7(spark, d):
    return layers.hotspot_layer(H.cluster_profiles(quadrants(spark, d))).withColumns({
        "lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("r8_demographic_zone_list", sql("zon", f"""@{_PROFILES},
c AS (SELECT zone, avg(latitude) AS lat, avg(longitude) AS lon, count(*) AS n FROM zon GROUP BY 1)
SELECT zone, round(lat, 6) AS center_lat, round(lon, 6) AS center_lon, n AS crime_count,
  dominant_value AS dominant_demo FROM c JOIN prof USING (zone)
WHERE attribute = 'vic_age_group'"""))
def r8(spark, d):
    table = zones.demographic_zone_table(zoned(spark, d))
    return table.select("zone", F.round("center_lat", 6).alias("center_lat"),
                        F.round("center_lon", 6).alias("center_lon"), "crime_count",
                        F.get("profiles", 0)["dominant_value"].alias("dominant_demo"))


@query("r8_demographic_analysis")
def r8_model(spark, d):
    """Fitted zones with concentration per attribute and the importance of each attribute."""
    rows = demographic_rows(spark, d)
    weights = zones.attribute_importance(rows)
    return zones.demographic_profiles(rows).drop("value_counts").join(weights, "attribute")


@query("r9_map_layers")
def r9(spark, d):
    return layers.map_layers(
        layers.hotspot_layer(H.cluster_profiles(quadrants(spark, d))),
        layers.demographic_layer(demographic_rows(spark, d)),
        layers.density_layer(density(spark, d)))


@query("r9_layers_of_given_zones", sql("quad zon", f"""@{_GRID},{NUMBERED},
{_PROFILES.lstrip().replace('FROM zon', 'FROM num')},
c AS (SELECT zone, avg(latitude) AS lat, avg(longitude) AS lon FROM num GROUP BY 1)
SELECT 'dbscan_clusters' AS layer, CAST(cluster AS BIGINT) AS id, round(avg(latitude), 6) AS lat,
  round(avg(longitude), 6) AS lon, count(*) AS crime_count, CAST(NULL AS VARCHAR) AS dominant_demo,
  CAST(NULL AS DOUBLE) AS density, CAST(NULL AS VARCHAR) AS classification
FROM quad WHERE cluster <> -1 GROUP BY cluster
UNION ALL SELECT 'demographic_zones', zone, round(lat, 6), round(lon, 6), NULL, dominant_value, NULL, NULL
FROM c JOIN prof USING (zone) WHERE attribute = 'vic_age_group'
UNION ALL SELECT 'density_zones', NULL, round(lat, 6), round(lon, 6), NULL, NULL, round(density, 6), classification
FROM grid"""))
def r9_given(spark, d):
    """The three layers in one table, with the hotspots by quadrant and fixed zones."""
    out = layers.map_layers(
        layers.hotspot_layer(H.cluster_profiles(quadrants(spark, d))),
        layers.demographic_layer(numbered_zones(spark, d)), layers.density_layer(density(spark, d)))
    return out.select("layer", F.col("id").cast("long").alias("id"), F.round("lat", 6).alias("lat"),
                      F.round("lon", 6).alias("lon"), "crime_count", "dominant_demo",
                      F.round("density", 6).alias("density"), "classification")


# --- request texts --------------------------------------------------------------------------

@query("r10_request_parts", sql("req", """
SELECT loc_id, CASE WHEN contains(message, ',') THEN trim(split_part(message, ',', 1)) END
  AS amenity, CASE WHEN contains(message, ',') THEN
  trim(substr(message, instr(message, ',') + 1)) END AS address FROM req"""))
def r10(spark, d):
    t = F.col("message")
    return fx.requests(spark, d).select("loc_id", T.before_comma(t).alias("amenity"),
                                        T.after_comma(t).alias("address"))


@query("r13_safety_levels", sql("zon", f"""@
s AS (SELECT zone, {half_up(_SCORE, 1)} AS safety_score FROM zon GROUP BY 1)
SELECT zone, safety_score, {_LEVEL} AS safety_level FROM s"""))
def r13(spark, d):
    score = C.round_half_up(F.col("safety_score"), 1)
    return zones.zone_scores(zoned(spark, d)).select(
        "zone", score.alias("safety_score"), C.safety_level(score).alias("safety_level"))


@query("r14_score_colours", sql("zon", f"""@
s AS (SELECT zone, {half_up(_SCORE, 1)} AS safety_score FROM zon GROUP BY 1)
SELECT zone, {_COLOUR} AS colour FROM s"""))
def r14(spark, d):
    score = C.round_half_up(F.col("safety_score"), 1)
    return zones.zone_scores(zoned(spark, d)).select("zone", C.score_colour(score).alias("colour"))


def _context(column, part):
    rows = [(words, quoted(part(rest))) for words, *rest in rules.AMENITY_CONTEXTS]
    return cases(rows, lambda ws: "(" + " OR ".join(
        contains(f"lower({column})")(w) for w in ws) + ")",
        quoted(part(list(rules.DEFAULT_CONTEXT))))


@query("r16_amenity_context", sql("loc", f"""
SELECT loc_id, {_context('amenity_type', lambda r: r[0])} AS context_group,
  {_context('amenity_type', lambda r: '; '.join(r[1]))} AS concerns,
  {_context('amenity_type', lambda r: r[2])} AS focus FROM loc"""))
def r16(spark, d):
    context = T.amenity_context(F.col("amenity_type"))
    return fx.locations(spark, d).select(
        "loc_id", context["group"].alias("context_group"),
        F.array_join(context["concerns"], "; ").alias("concerns"), context["focus"].alias("focus"))


_CONCERNS = ", ".join(
    f"({quoted(group)}, {i}, {quoted(c)})" for group, cs in
    [(r[1], r[2]) for r in rules.AMENITY_CONTEXTS] + [rules.DEFAULT_CONTEXT[:2]]
    for i, c in enumerate(cs))


def _related(amenity):
    return f"""
who AS (SELECT loc_id, CASE WHEN length({amenity}) > 0 THEN
  {_context(amenity, lambda r: r[0])} END AS g FROM asked),
con(g, ord, concern) AS (VALUES {_CONCERNS}),
rel AS (SELECT loc_id, crime_type, c, row_number() OVER (PARTITION BY loc_id ORDER BY ord, c DESC,
  crime_type) AS r FROM who JOIN con USING (g) JOIN ty USING (loc_id)
  WHERE contains(lower(crime_type), lower(concern)) OR contains(lower(concern), lower(crime_type)))
"""


@query("r17_relevant_offenses", sql("loc zon", f"""@{_CORE},
asked AS (SELECT loc_id, amenity_type FROM loc),{_related('amenity_type')}
SELECT loc_id, string_agg(crime_type || '=' || c, '; ' ORDER BY r) AS offenses
FROM rel WHERE r <= 3 GROUP BY 1"""))
def r17(spark, d):
    related = T.relevant_offenses(T.amenity_context(F.col("amenity_type"))["concerns"],
                                  F.col("crime_types"))
    return core_cards(spark, d).select("loc_id", as_text(related).alias("offenses")).filter(
        "offenses <> ''")


def _has(words):
    return "(" + " OR ".join(contains("t")(w) for w in words) + ")"


def _listed(items):
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def _if(condition, value):
    return f"CASE WHEN {condition} THEN {quoted(value)} END"


_PARSED = f"""
g AS (SELECT loc_id, group_text, trim(lower(group_text)) AS t FROM req),
pg AS (SELECT loc_id, t, coalesce(nullif(list_sum(list_transform(
    regexp_extract_all(t, '\\b(\\d+)\\b', 1), lambda x: CAST(x AS BIGINT))), 0), 1) AS people,
  {_listed([f"'{k}=' || nullif(regexp_extract(t, {quoted(p)}, 1), '')"
            for k, p in rules.GROUP_COUNT_PATTERNS])} AS counts,
  {_listed([_if(_has(w), k) for k, w, _ in rules.VULNERABLE_GROUPS])} AS vulnerable,
  {_listed([_if(_has(w), rules.RACIAL_FACTOR) for _, w, b in rules.GROUP_RACES if b] +
           [_if(_has(w), r) for _, w, r in rules.VULNERABLE_GROUPS])} AS risks,
  {_listed([_if(_has(w), k) for k, w, _ in rules.GROUP_RACES])} AS races
  FROM g WHERE length(group_text) > 0)"""


@query("r18_parse_groups", sql("req", f"""@{_PARSED}
SELECT loc_id, CAST(people AS BIGINT) AS total_people, array_to_string(counts, '; ')
  AS demographics, array_to_string(vulnerable, '; ') AS vulnerable_groups,
  array_to_string(risks, '; ') AS risk_factors, array_to_string(races, '; ') AS races FROM pg"""))
def r18(spark, d):
    parsed = fx.requests(spark, d).select("loc_id", T.parse_group(F.col("group_text")).alias("g"))
    counts = F.transform("g.demographics", lambda x: F.concat(
        x["type"], F.lit("="), x["count"].cast("string")))
    return parsed.filter("g IS NOT NULL").select(
        "loc_id", "g.total_people", F.array_join(counts, "; ").alias("demographics"),
        *[F.array_join(f"g.{c}", "; ").alias(c)
          for c in ("vulnerable_groups", "risk_factors", "races")])


# --- reports --------------------------------------------------------------------------------

def _text(value):
    return quoted(value)


def _block(lines):
    """Several lines, each after a line break."""
    return _text("".join("\n" + line for line in lines))


def _offense_lines(words):
    hits = "(" + " OR ".join(contains("upper(crime_type)")(w) for w in words) + ")"
    return (f"coalesce((SELECT string_agg({_text(chr(10) + '  ⚠️ ')} || crime_type || ': ' || c || "
            f"' incidents', '' ORDER BY c DESC, crime_type) FROM ty WHERE ty.loc_id = x.loc_id AND "
            f"{hits}), '')")


def _group_advice_sql():
    t = rules.GROUP_TEXT
    parts = [
        f"{_text(t['title'])} || {_text(chr(10) + t['people'][0])} || people || "
        f"{_text(t['people'][1])}",
        f"CASE WHEN len(races) > 0 THEN {_text(chr(10) + t['race'])} || "
        "array_to_string(races, ', ') ELSE '' END",
        f"CASE WHEN len(vulnerable) > 0 THEN {_text(chr(10) + t['includes'])} || "
        "array_to_string(list_transform(vulnerable, lambda v: upper(left(v, 1)) || substr(v, 2)), "
        "', ') ELSE '' END"]
    for group, below, above, words in rules.GROUP_ADVICE:
        more = f" || {_offense_lines(words)}" if words else ""
        parts.append(
            f"CASE WHEN list_contains(vulnerable, {quoted(group)}) THEN (CASE WHEN "
            f"safety_score < {rules.ADVICE_SCORE} THEN {_block(below)} ELSE {_block(above)} END)"
            f"{more} ELSE '' END")
    bias = _offense_lines(t["racial_words"])
    parts.append(
        f"CASE WHEN list_contains(risks, {quoted(rules.RACIAL_FACTOR)}) THEN "
        f"{_block([t['racial']])} || {bias} || CASE WHEN safety_score < {rules.ADVICE_SCORE} OR "
        f"{bias} <> '' THEN {_block(t['racial_care'])} ELSE {_block(t['racial_clear'])} END "
        "ELSE '' END")
    parts.append(f"CASE WHEN people = 1 THEN {_block(t['solo'])} WHEN people >= "
                 f"{rules.LARGE_GROUP} THEN {_block(t['large'])} ELSE '' END")
    return " || ".join(parts)


@query("r19_group_advice", sql("loc zon req", f"""@{_CORE},{_PARSED},
x AS (SELECT pg.*, safety_score FROM pg JOIN sc USING (loc_id))
SELECT loc_id, {_group_advice_sql()} AS advice FROM x"""))
def r19(spark, d):
    df = core_cards(spark, d).join(fx.requests(spark, d), "loc_id")
    profile = T.parse_group(F.col("group_text"))
    df = df.withColumn("profile", profile).filter("profile IS NOT NULL")
    return df.select("loc_id", T.group_advice(
        F.col("profile"), F.col("safety_score"), F.col("crime_types")).alias("advice"))


def _report_sql():
    t = rules.REPORT_TEXT
    advice = "CASE " + " ".join(
        f"WHEN contains(g, {quoted(word)}) THEN (CASE WHEN safety_score < {rules.ADVICE_SCORE} THEN "
        f"{_block(below)} ELSE {_block(above)} END)"
        for word, below, above in rules.CONTEXT_ADVICE) + " ELSE '' END"
    general = "CASE " + " ".join(
        f"WHEN safety_score < {b} THEN {_block(lines)}" if b is not None
        else f"ELSE {_block(lines)}" for b, lines in rules.GENERAL_ADVICE) + " END"
    nl = "\n"
    parts = [
        _text(t["title"]),
        f"CASE WHEN length(message) > 0 THEN {_text(nl + t['location'])} || message ELSE '' END",
        f"{_text(nl + t['score'])} || CAST(safety_score AS VARCHAR) || '/100 (' || {_LEVEL} || ')'",
        _text(nl + t["top"]),
        f"coalesce((SELECT string_agg({_text(nl + '  ')} || r || '. ' || crime_type || ': ' || c || "
        "' incidents', '' ORDER BY r) FROM n WHERE n.zone = x.zone AND r <= 3), '')",
        _text(nl + t["nearby"]),
        f"{_text(nl + t['nearby_total'])} || coalesce(nearby, 0)",
        f"CASE WHEN peak IS NOT NULL THEN {_text(nl + t['peak'])} || upper(left(peak, 1)) || "
        "substr(peak, 2) || ' (' || CAST(round_even(m * 100::DOUBLE / total, 0) AS BIGINT) || "
        "'% of crimes)' ELSE '' END",
        _text(nl + t["amenities"]),
        f"{_text(nl + t['amenity_total'].format(km=3))} || coalesce(nearby_count, 0)",
        f"CASE WHEN nearby_count > 0 THEN {_text(nl + t['amenity_types'])} || (SELECT string_agg("
        f"{_text(nl + '  - ')} || upper(left(type, 1)) || lower(substr(type, 2)) || ': ' || c, '' "
        "ORDER BY c DESC, type) FROM kinds WHERE kinds.loc_id = x.loc_id) ELSE '' END",
        f"CASE WHEN g IS NOT NULL THEN {_text(nl + t['group'])} || upper(g) ELSE '' END",
        f"coalesce((SELECT {_text(nl + t['concerns'])} || string_agg({_text(nl + '  • ')} || "
        "crime_type || ': ' || c || ' incidents', '' ORDER BY r) FROM rel WHERE "
        "rel.loc_id = x.loc_id AND r <= 3), '')",
        _text(nl + t["advice"]),
        f"CASE WHEN g IS NOT NULL THEN {advice} ELSE '' END", general]
    return " || ".join(parts)


@query("r15_text_reports", sql("loc zon req am", f"""@{_CORE},{_AM},
asked AS (SELECT loc_id, message, CASE WHEN contains(message, ',') THEN
  trim(split_part(message, ',', 1)) END AS amenity FROM req),{_related('amenity')},
x AS (SELECT sc.*, message, g, nearby, peak, m, total, nearby_count FROM sc JOIN asked
  USING (loc_id) JOIN who USING (loc_id) LEFT JOIN pb USING (loc_id)
  LEFT JOIN acard USING (loc_id))
SELECT loc_id, {_report_sql()} AS report FROM x"""))
def r15(spark, d):
    """Report of each request at its location; amenities within 3 km, as the test set is sparse."""
    df = core_cards(spark, d).drop("amenity_type").join(fx.requests(spark, d), "loc_id")
    amenities = scoring.amenity_cards(fx.locations(spark, d), fx.amenities(spark, d), 3.0)
    df = df.join(amenities.select("loc_id", "nearby_count", "type_counts"), "loc_id", "left")
    kinds = F.coalesce("type_counts", F.array().cast("array<struct<value:string,count:bigint>>"))
    return df.select("loc_id", T.safety_report(
        F.col("safety_score"), F.col("message"), T.before_comma(F.col("message")),
        F.col("common_crimes"), F.col("nearby_crime_count"), F.col("crime_types"), F.col("peak"),
        F.col("nearby_count"), kinds, amenity_km=3.0).alias("report"))


@query("r15_full_answers")
def r15_full(spark, d):
    """From request text to answer: coordinates by gazetteer, full card, report and group advice.

    A request whose place is not found is answered too, with a status that says so.
    """
    asked = fx.requests(spark, d)
    found = stored(places.coordinates_of(asked, fx.gazetteer(spark, d)))
    where = stored(found.filter("lat IS NOT NULL").join(asked, "loc_id").select(
        "loc_id", "lat", "lon", "city", "message", "group_text",
        T.before_comma(F.col("message")).alias("amenity_type"),
        F.lit(rules.DEFAULT_GROUP).alias("demographic_group")))
    cards = card.safety_cards(where, fx.incidents(spark, d), fx.amenities(spark, d),
                              models(spark, d), now=NOW)
    answers = card.with_reports(cards).select("loc_id", "safety_score", "safety_level", "report")
    return found.join(answers, "loc_id", "left").select(
        "loc_id", "lat", "lon", "city", "safety_score", "safety_level", "report",
        F.when(F.col("lat").isNotNull(), rules.ANSWER_STATUS["found"]).otherwise(
            rules.ANSWER_STATUS["not_found"]).alias("status"))
