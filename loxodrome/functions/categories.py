"""Category rules: lookups with explicit other and missing levels, and tag predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER, MISSING = "__OTHER__", "__MISSING__"

#: Which tags make a way unfit for walking.
EXCLUDED_HIGHWAY = ("motorway", "motorway_link", "construction", "proposed", "abandoned", "razed", "raceway", "bus_guideway", "escape")
NO_ACCESS = ("no", "private")
FOOT_ALLOWED = ("yes", "designated", "permissive")

#: Tag values of the facility classes.
FOOD = ("restaurant", "cafe", "fast_food", "bar", "pub", "food_court", "ice_cream", "biergarten")
EDUCATION = ("school", "kindergarten", "college", "university", "library", "language_school", "music_school", "driving_school")
MEDICAL = ("hospital", "clinic", "doctors", "dentist", "pharmacy", "nursing_home", "veterinary")
EXCLUDED_LEISURE = ("picnic_table", "outdoor_seating", "slipway")
EXCLUDED_AMENITY = (
    "bench", "waste_basket", "waste_disposal", "recycling", "bicycle_parking", "bicycle_repair_station", "parking", "parking_entrance", "parking_space", "motorcycle_parking", "taxi", "bus_station",
    "shelter", "drinking_water", "water_point", "toilets", "vending_machine", "charging_station", "grit_bin", "post_box", "telephone", "fountain", "clock", "letter_box", "loading_dock",
)
DISABLED = ("no", "disused", "abandoned", "demolished", "construction", "proposed")
POI_KEYS = ("amenity", "shop", "tourism", "leisure", "office", "healthcare", "craft", "historic")


def known(value: Column) -> Column:
    """The category, with null and empty text as MISSING."""
    return F.when(value.isNull() | (value == ""), MISSING).otherwise(value)


def display_group(value: Column, groups: Mapping[str, Sequence[str]]) -> Column:
    """Group of a category: MISSING stays, unlisted ones are OTHER; one category in two groups is an error."""
    listed = [v for values in groups.values() for v in values]
    if len(listed) != len(set(listed)):
        raise ValueError("a category is in more than one group")
    out = F.when(known(value) == MISSING, MISSING)
    for group, values in groups.items():
        out = out.when(value.isin(*values), group)
    return out.otherwise(OTHER)


def _is(tags: Column, key: str, *values: str) -> Column:
    return F.coalesce(tags[key].isin(*values), F.lit(False))


def walkable(tags: Column) -> Column:
    """A way that a pedestrian may use; an allowed foot tag overrides motorroad and access."""
    allowed = _is(tags, "foot", *FOOT_ALLOWED)
    road = F.coalesce(tags["highway"] != "", F.lit(False)) & ~_is(tags, "highway", *EXCLUDED_HIGHWAY)
    barred = _is(tags, "motorroad", "yes") | _is(tags, "access", *NO_ACCESS)
    return road & ~_is(tags, "area", "yes") & ~_is(tags, "foot", "no") & (allowed | ~barred)


def water(tags: Column) -> Column:
    surface = tags["water"].isNotNull() & (F.coalesce(tags["natural"], F.lit("water")) == "water")
    return _is(tags, "natural", "water") | _is(tags, "waterway", "riverbank") | _is(tags, "landuse", "reservoir") | surface


def has_poi_tag(tags: Column) -> Column:
    return F.coalesce(*[tags[k] for k in POI_KEYS]).isNotNull()


def facility(tags: Column) -> Column:
    """First class that fits, in order of priority; null for stops, disabled and excluded ones."""

    def active(key: str) -> Column:
        return F.coalesce(tags[key] != "", F.lit(False)) & ~_is(tags, key, *DISABLED)

    stop = _is(tags, "railway", "station", "halt", "platform", "stop") | _is(tags, "public_transport", "station", "platform", "stop_position")
    rules = [
        (active("healthcare") | _is(tags, "amenity", *MEDICAL), "healthcare"), (_is(tags, "amenity", *FOOD), "food"), (_is(tags, "amenity", *EDUCATION), "education"),
        (active("shop"), "shop"), (active("tourism"), "tourism"), (active("leisure") & ~_is(tags, "leisure", *EXCLUDED_LEISURE), "leisure"),
        (active("office"), "office"), (active("amenity") & ~_is(tags, "amenity", *EXCLUDED_AMENITY), "other_amenity"),
    ]
    out = F.when(stop, F.lit(None).cast("string"))
    for rule, name in rules:
        out = out.when(rule, name)
    return out


def code_prefix(code: Column, prefixes: Sequence[str], excluded: Sequence[str]) -> Column:
    """Municipality codes of these prefectures, without excluded ones and whole-prefecture codes (xx000)."""
    return F.substring(code, 1, 2).isin(*prefixes) & ~code.isin(*excluded) & ~code.endswith("000")
