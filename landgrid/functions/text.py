"""Tolerant casts, class mappings, address patterns, bands of building age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of map tags and of registry purposes.
TAG_CLASSES = {
    "apartment": ["apartments"],
    "house": ["house", "detached", "semidetached_house", "terrace", "bungalow"],
    "commercial": ["retail", "commercial", "supermarket", "kiosk", "shop", "office", "industrial", "warehouse"],
}
PURPOSE_CLASSES = {
    "apartment": ["многоквартирный дом"],
    "house": ["жилой дом", "жилое", "садовый дом"],
    "commercial": ["нежилое"],
}
# First and last year of each era; open where None.
ERAS = [
    (None, 1916, "pre_revolution"),
    (1917, 1945, "early_soviet"),
    (1946, 1956, "stalin"),
    (1957, 1968, "khrushchev"),
    (1969, 1980, "brezhnev"),
    (1981, 1991, "late_soviet"),
    (1992, 2000, "90s_transition"),
    (2001, 2010, "2000s"),
    (2011, 2020, "2010s"),
    (2021, None, "new_2020+"),
]
# Districts within the city, and the address patterns. (?U) makes \s and the like match beyond ASCII.
CITY_DISTRICTS = ["Советский", "Приволжский", "Авиастроительный", "Кировский", "Московский", "Вахитовский", "Ново-Савиновский"]
RURAL_OKRUG = r"(?U)(?:^|,\s*)([А-Я][а-яА-Я\-]+?)\s+муниципальный\s+район"
URBAN_OKRUG = r"(?U)г\.о\.\s*([^,]+)"
CITY = r"(?U)(?:^|,\s*)(?:г|город)\s+([А-Я][^,]+)"
VILLAGE = r"(?U)(?:^|,\s*)(?:д|с|п|пос|дер|пгт)\s+([А-Я][^,]+)"
DISTRICT = rf"(?U)({'|'.join(CITY_DISTRICTS)})\s+район"
#: Only the last district of the alternation needs the word after it.
TRAILING = rf"(?U)\s+(?:муниципальный\s+район|{'|'.join(CITY_DISTRICTS)}\s+район).*$"


def to_str(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def to_float(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def to_int(c: Column) -> Column:
    """Whole numbers, also from texts such as '7.9', which is cut to 7; what isn't a number is null."""
    s = F.trim(c.cast("string"))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def digits(c: Column) -> Column:
    """The number that all digits of a text make; null if it has none."""
    return F.nullif(F.regexp_replace(c, r"\D", ""), F.lit("")).try_cast("bigint")


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """What a group matched; null, not '', without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def mapped(c: Column, classes: dict[str, list[str]], strict: bool = False) -> Column:
    """The class that lists a value; null for others, or an error if strict."""
    pairs = [F.lit(x) for name, values in classes.items() for v in values for x in (v, name)]
    got = F.element_at(F.create_map(*pairs), c)
    return F.when(got.isNull() & c.isNotNull(), F.raise_error(F.concat(F.lit("unknown value: "), c)).cast("string")).otherwise(got) if strict else got


def tag_class(tag: Column) -> Column:
    return mapped(F.lower(F.trim(tag)), TAG_CLASSES)


def purpose_class(purpose: Column) -> Column:
    return mapped(F.lower(F.trim(purpose)), PURPOSE_CLASSES)


def era(year: Column) -> Column:
    out = F.when(year.isNull(), "unknown")
    for low, high, name in ERAS:
        out = out.when((F.lit(True) if low is None else year >= low) & (F.lit(True) if high is None else year <= high), name)
    return out.otherwise("unknown")


def stripped(c: Column, chars: str = " \t.,;") -> Column:
    return F.btrim(c, F.lit(chars))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; null stays null (greatest and least alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def noise(key: Column, seed: int) -> Column:
    """Standard normal values by Box-Muller from hashes of a key: the same for any partitioning, new for another seed."""
    u = lambda s: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(s)), F.lit(2**52)).cast("double") + 0.5) / float(2**52)
    return F.sqrt(F.lit(-2.0) * F.ln(u(1))) * F.cos(F.lit(6.283185307179586) * u(2))
