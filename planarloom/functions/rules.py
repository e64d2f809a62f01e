"""Classification of tag lists by rule tables.

A rule gives a value to a tag; ``*`` stands for any value of the key. The tags are taken in order and the first one whose
key is known and whose value, or else ``*``, has a rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules that results depend on. (key, value, result)
BARRIER_RULES = [
    ("highway", "living_street", 1),
    ("highway", "residential", 2),
    ("highway", "track", 1),
    ("highway", "unclassified", 2),
    ("highway", "tertiary", 4),
    ("highway", "tertiary_link", 4),
    ("highway", "secondary", 8),
    ("highway", "secondary_link", 8),
    ("highway", "primary", 16),
    ("highway", "primary_link", 16),
    ("highway", "motorway", 30),
    ("highway", "motorway_link", 30),
    ("highway", "trunk", 30),
    ("highway", "trunk_link", 30),
    ("railway", "*", 30),
    ("natural", "water", 10),
    ("waterway", "stream", 5),
]
BARRIER_CLASS_RULES = [
    ("highway", "service", "residential"),
    ("highway", "pedestrian", "residential"),
    ("highway", "living_street", "residential"),
    ("highway", "residential", "residential"),
    ("highway", "track", "rural"),
    ("highway", "unclassified", "rural"),
    ("railway", "*", "industrial"),
    ("waterway", "*", "water"),
    ("natural", "water", "water"),
]
LANDUSE_RULES = [
    ("landuse", "residential", "residential"),
    ("landuse", "industrial", "industrial"),
    ("amenity", "school", "school"),
    ("amenity", "college", "school"),
    ("amenity", "university", "school"),
    ("amenity", "kindergarten", "school"),
    ("landuse", "meadow", "rural"),
    ("landuse", "farmland", "rural"),
    ("landuse", "forest", "natural"),
    ("landuse", "grass", "natural"),
    ("leisure", "park", "natural"),
    ("landuse", "retail", "industrial"),
    ("natural", "water", "water"),
    ("waterway", "riverbank", "water"),
]


def classify(tags: Column, rules: list[tuple]) -> Column:
    """What the rules say of an array of tags (k, v); null when none applies, and for null tags. Tags with a null key or
    value are passed over."""
    table = F.create_map(*[x for k, v, out in rules for x in (F.lit(f"{k}={v}"), F.lit(out))])
    said = F.transform(F.filter(tags, lambda t: t["k"].isNotNull()), lambda t: F.coalesce(table[F.concat(t["k"], F.lit("="), F.coalesce(t["v"], F.lit("")))], table[F.concat(t["k"], F.lit("=*"))]))
    return F.get(F.filter(said, lambda x: x.isNotNull()), F.lit(0))


def rules_sql(rules: list[tuple]) -> str:
    """The table as SQL VALUES."""
    quote = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return ", ".join(f"('{k}', '{v}', {quote(out)})" for k, v, out in rules)
