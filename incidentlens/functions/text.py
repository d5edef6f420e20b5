"""Address and group texts, contexts, and the lines of the text reports, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C
from . import rules


# --- addresses ------------------------------------------------------------------------------

def direct_coordinates(text: Column) -> Column:
    """Struct (lat, lon) of the first "number, number" in a text; null when out of range."""
    part = lambda i: F.regexp_extract(
        text, rules.COORDINATE_PATTERN, i).try_cast("double")
    lat, lon = part(1), part(2)
    return F.when(lat.between(-90, 90) & lon.between(-180, 180),
                  F.struct(lat.alias("lat"), lon.alias("lon")))


def without_business_word(text: Column) -> Column:
    words = "|".join(rules.BUSINESS_WORDS)
    return F.regexp_replace(text, rf"(?i)^({words}),\s*", "")


def before_comma(text: Column) -> Column:
    """Amenity word of a request: what stands before the first comma, null without one."""
    return F.when(text.contains(","), C.strip(F.substring_index(text, ",", 1)))


def after_comma(text: Column) -> Column:
    return F.when(text.contains(","), C.strip(F.get(F.split(text, ",", 2), F.lit(1))))


def place_key(text: Column) -> Column:
    return F.lower(C.strip(text))


def city_of_name(name: Column) -> Column:
    """City code of a place name, null when it is not known."""
    key = place_key(name)
    return reduce(lambda acc, kv: acc.when(key.isin(kv[1]), kv[0]), rules.CITY_ALIASES.items(), F)


def city_of_address(fields) -> Column:
    """City code by the first address field that names a known place."""
    present = [f for f in rules.ADDRESS_FIELDS if f in fields]
    if not present:
        return F.lit(None).cast("string")
    return F.coalesce(*[city_of_name(F.col(f)) for f in present])


def city_of_coordinates(lat: Column, lon: Column) -> Column:
    """City code by box (the boxes do not overlap)."""
    chain = F
    for code, (_, a, b, c, d) in rules.CITY_BOXES.items():
        chain = chain.when(lat.between(a, b) & lon.between(c, d), code)
    return chain


# --- context of an amenity ------------------------------------------------------------------

def amenity_context(amenity: Column) -> Column:
    """Struct (group, concerns, focus) by the first word set that occurs; null for no amenity."""
    text = F.lower(amenity)

    def struct(group, concerns, focus):
        return F.struct(F.lit(group).alias("group"),
                        F.array(*[F.lit(c) for c in concerns]).alias("concerns"),
                        F.lit(focus).alias("focus"))

    chain = F
    for words, *context in rules.AMENITY_CONTEXTS:
        chain = chain.when(C.contains_any(text, words), struct(*context))
    return F.when(amenity.isNotNull(), chain.otherwise(struct(*rules.DEFAULT_CONTEXT)))


def relevant_offenses(concerns: Column, offenses: Column, most: int = 3) -> Column:
    """Offenses that contain a concern or are contained in it: per concern, then per offense."""
    def hits(concern):
        word = F.lower(concern)
        return F.filter(offenses, lambda o: F.lower(o["value"]).contains(word)
                        | word.contains(F.lower(o["value"])))

    return F.slice(F.flatten(F.transform(concerns, hits)), 1, most)


# --- description of a group -----------------------------------------------------------------

def _mentions(text: Column, words, whole_words: bool) -> Column:
    if whole_words:
        return text.rlike(r"\b(" + "|".join(words) + r")\b")
    return C.contains_any(text, words)


def parse_group(description: Column, whole_words: bool = False) -> Column:
    """Struct of a group description: people, counts by type, vulnerable groups, risks, races.

    Words count wherever they occur, also inside longer words, unless `whole_words` is set. An empty
    description gives null.
    """
    text = C.strip(F.lower(description))
    numbers = F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), F.lit(1))
    people = F.aggregate(
        numbers, F.lit(0).cast("long"),
        lambda total, n: total + F.coalesce(n.try_cast("bigint"), F.lit(0)))
    races, risks, groups = [], [], []
    for label, words, biased in rules.GROUP_RACES:
        hit = _mentions(text, words, whole_words)
        races.append(F.when(hit, label))
        if biased:
            risks.append(F.when(hit, rules.RACIAL_FACTOR))
    for label, words, risk in rules.VULNERABLE_GROUPS:
        hit = _mentions(text, words, whole_words)
        groups.append(F.when(hit, label))
        risks.append(F.when(hit, risk))
    counts = []
    for label, pattern in rules.GROUP_COUNT_PATTERNS:
        n = F.regexp_extract(text, pattern, 1).try_cast("bigint")
        counts.append(F.when(n.isNotNull(), F.struct(F.lit(label).alias("type"),
                                                     n.alias("count"))))
    some = lambda items: F.array_compact(F.array(*items))
    return F.when(F.length(description) > 0, F.struct(
        F.when(people == 0, F.lit(1).cast("long")).otherwise(people).alias("total_people"),
        some(counts).alias("demographics"), some(groups).alias("vulnerable_groups"),
        some(risks).alias("risk_factors"), some(races).alias("races")))


# --- lines of the reports -------------------------------------------------------------------

def _lines(*items) -> Column:
    """Array of text lines from columns, strings, lists of strings and line arrays."""
    parts = []
    for item in items:
        if isinstance(item, str):
            parts.append(F.array(F.lit(item)))
        elif isinstance(item, list):
            parts.append(F.array(*[F.lit(x) for x in item]))
        else:
            parts.append(item)
    return F.concat(*parts)


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _when(condition: Column, lines: Column) -> Column:
    return F.when(condition, lines).otherwise(_no_lines())


def _capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def safety_report(score: Column, address: Column, amenity: Column, top: Column,
                  nearby: Column, offenses: Column, peak: Column | None = None,
                  amenity_count: Column | None = None,
                  amenity_types: Column | None = None,
                  amenity_km: float = rules.AMENITY_RADIUS_KM) -> Column:
    """Text report of a location; sections without data are left out.

    `amenity_km` is the radius within which amenities were counted.
    `top`, `offenses` and `amenity_types` are arrays of (value, count); `peak` is (bucket, percent).
    """
    t = rules.REPORT_TEXT
    numbered = F.transform(
        F.slice(F.coalesce(top, F.array().cast("array<struct<value:string,count:bigint>>")), 1, 3),
        lambda x, i: F.concat(F.lit(t["numbered"][0]), (i + 1).cast("string"), F.lit(t["numbered"][1]), x["value"],
                              F.lit(t["is"]), x["count"].cast("string"), F.lit(t["incidents"])))
    parts = [
        F.array(F.lit(t["title"])),
        _when(F.length(address) > 0, F.array(F.concat(F.lit(t["location"]), address))),
        F.array(F.concat(F.lit(t["score"]), score.cast("string"), F.lit(t["of_hundred"][0]),
                         C.safety_level(score), F.lit(t["of_hundred"][1]))),
        F.array(F.lit(t["top"])), numbered, F.array(F.lit(t["nearby"])),
        F.array(F.concat(F.lit(t["nearby_total"]), nearby.cast("string"))),
    ]
    if peak is not None:
        parts.append(_when(peak.isNotNull(), F.array(F.concat(
            F.lit(t["peak"]), F.initcap(peak["bucket"]), F.lit(t["share"][0]),
            F.bround(peak["percent"], 0).cast("long").cast("string"), F.lit(t["share"][1])))))
    if amenity_count is not None:
        kinds = F.transform(amenity_types, lambda x: F.concat(
            F.lit(t["dash"]), _capitalised(x["value"]), F.lit(t["is"]), x["count"].cast("string")))
        parts += [
            F.array(F.lit(t["amenities"]),
                    F.concat(F.lit(t["amenity_total"].format(km=f"{amenity_km:g}")),
                             amenity_count.cast("string"))),
            _when(F.size(amenity_types) > 0, _lines(t["amenity_types"], kinds))]
    context = amenity_context(amenity)
    related = relevant_offenses(context["concerns"], offenses)
    has_context = F.length(amenity) > 0
    parts += [
        _when(has_context, F.array(F.concat(F.lit(t["group"]), F.upper(context["group"])))),
        _when(has_context & (F.size(related) > 0), _lines(t["concerns"], F.transform(
            related, lambda x: F.concat(F.lit(t["bullet"]), x["value"], F.lit(t["is"]),
                                        x["count"].cast("string"), F.lit(t["incidents"]))))),
        F.array(F.lit(t["advice"])),
    ]
    low = score < rules.ADVICE_SCORE
    advice = F
    for word, below, above in rules.CONTEXT_ADVICE:
        advice = advice.when(
            has_context & context["group"].contains(word),
            F.when(low, _lines(below)).otherwise(_lines(above)))
    parts.append(advice.otherwise(_no_lines()))
    general = F
    for bound, lines in rules.GENERAL_ADVICE:
        general = (general.otherwise(_lines(lines)) if bound is None
                   else general.when(score < bound, _lines(lines)))
    parts.append(general)
    return F.array_join(F.concat(*parts), "\n")


def group_advice(profile: Column, score: Column, offenses: Column) -> Column:
    """Advice text for a parsed group; null without one. `offenses` as in `safety_report`."""
    t, mark = rules.GROUP_TEXT, rules.REPORT_TEXT
    low = score < rules.ADVICE_SCORE
    joined = lambda items: F.array_join(items, ", ")

    def matching(words):
        return F.transform(
            F.filter(offenses, lambda o: C.contains_any(F.upper(o["value"]), words)),
            lambda o: F.concat(F.lit(mark["warning"]), o["value"], F.lit(mark["is"]),
                               o["count"].cast("string"), F.lit(mark["incidents"])))

    parts = [
        F.array(F.lit(t["title"]), F.concat(F.lit(t["people"][0]), profile["total_people"]
                                            .cast("string"), F.lit(t["people"][1]))),
        _when(F.size(profile["races"]) > 0,
              F.array(F.concat(F.lit(t["race"]), joined(profile["races"])))),
        _when(F.size(profile["vulnerable_groups"]) > 0, F.array(F.concat(
            F.lit(t["includes"]), F.initcap(joined(profile["vulnerable_groups"]))))),
    ]
    for group, below, above, words in rules.GROUP_ADVICE:
        lines = F.when(low, _lines(below)).otherwise(_lines(above))
        if words:
            lines = F.concat(lines, matching(words))
        parts.append(_when(F.array_contains(profile["vulnerable_groups"], group), lines))
    bias = matching(t["racial_words"])
    care = F.when(low | (F.size(bias) > 0), _lines(t["racial_care"])).otherwise(
        _lines(t["racial_clear"]))
    parts.append(_when(
        F.array_contains(profile["risk_factors"], rules.RACIAL_FACTOR),
        F.concat(_lines(t["racial"]), bias, care)))
    people = profile["total_people"]
    parts.append(F.when(people == 1, _lines(t["solo"]))
                 .when(people >= rules.LARGE_GROUP, _lines(t["large"])).otherwise(_no_lines()))
    return F.when(profile.isNotNull(), F.array_join(F.concat(*parts), "\n"))
