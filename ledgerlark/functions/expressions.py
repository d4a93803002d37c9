"""Small expressions that several plans use, all of them built from Spark's functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of service levels in days; fixed values.
PERIOD_DAYS = {"h": 1 / 24, "hour": 1 / 24, "hours": 1 / 24, "d": 1, "day": 1, "days": 1, "w": 7, "week": 7, "weeks": 7, "y": 365, "year": 365, "years": 365}


def _digit(s: Column, i: int) -> Column:
    return F.substring(s, i, 1).cast("int")


def is_tax_number(s: Column) -> Column:
    """Whether a string is a 10-digit tax number with a right check digit; the rule of the check digit is fixed."""

    def part(i: int) -> Column:
        moved = (_digit(s, i + 1) + (9 - i)) % 10
        power = (moved * 2 ** (9 - i)) % 9
        return F.when(moved == 0, 0).when(power == 0, 9).otherwise(power)

    return F.when(s.rlike("^[0-9]{10}$"), (10 - sum(part(i) for i in range(9)) % 10) % 10 == _digit(s, 10)).otherwise(False)


def is_citizen_number(s: Column) -> Column:
    """Whether a string is an 11-digit citizen number with two right check digits; their rule is fixed."""
    odd, even = sum(_digit(s, i) for i in (1, 3, 5, 7, 9)), sum(_digit(s, i) for i in (2, 4, 6, 8))
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(s, 10)
    last = (odd + even + _digit(s, 10)) % 10 == _digit(s, 11)
    return F.when(s.rlike("^[1-9][0-9]{10}$"), tenth & last).otherwise(False)


def failure_reason(failed: Column, total: Column, dimension: Column) -> Column:
    """`f/r rows failed (p%) dimension=d`."""
    percent = two_places(F.coalesce(failed / F.nullif(total, F.lit(0)), F.lit(0.0)) * 100)
    return F.format_string("%d/%d rows failed (%s%%) dimension=%s", failed, total, percent, dimension)


def two_places(x: Column) -> Column:
    """A double of 0 or more below 2^50 as text with two decimals, rounded by its exact binary value and halves to even, as C's printf does. Java's %.2f rounds the shortest decimal that reads as the double, and halves up."""
    whole, ones, half = F.floor(x), (1 << 53) - 1, F.lit(1 << 52)
    scaled = (x - whole) * float(1 << 53)
    bits = F.floor(scaled)  # below 2^53, so a hundred of them fit a long
    below = F.floor((scaled - bits) * float(1 << 53)) * 100  # what values under 1 have beyond
    more = bits * 100 + F.shiftright(below, 53)
    cents, rest = F.shiftright(more, 53), more.bitwiseAND(F.lit(ones))
    up = (rest > half) | ((rest == half) & ((below.bitwiseAND(F.lit(ones)) > 0) | (cents % 2 == 1)))
    cents = whole * 100 + cents + up.cast("long")
    return F.format_string("%d.%02d", F.floor((cents - cents % 100) / 100), cents % 100)


def root_cause(trace: Column) -> Column:
    """The message after the last `Caused by: `, or the first line."""
    last = F.substring_index(trace, "Caused by: ", -1)
    return F.trim(F.substring_index(last, "\n", 1))


def period_days(value: Column, unit: Column) -> Column:
    """A service level's period in days; null for an unknown unit."""
    out = F.lit(None).cast("double")
    for name, days in PERIOD_DAYS.items():
        out = F.when(F.lower(F.trim(unit)) == name, value.cast("double") * float(days)).otherwise(out)
    return out


#: A catalogue's categories of checks, by check type and by dimension; fixed values. All other checks assert something.
SCHEMA_CHECKS = ("field_is_present", "field_physical_type", "field_type")
CATEGORIES = {"timeliness": "FRESHNESS_ANOMALY", "coverage": "VOLUME_ANOMALY"}


def check_category(check_type: Column, dimension: Column) -> Column:
    """What a catalogue counts a check as."""
    out = F.lit("ASSERTION")
    for name, category in CATEGORIES.items():
        out = F.when(dimension == name, category).otherwise(out)
    return F.when(check_type.isin(*SCHEMA_CHECKS), "SCHEMA_CHANGE").otherwise(out)


def _members(json: Column) -> Column:
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_merged(left: Column, right: Column) -> Column:
    """A flat JSON object with another one's members put in; of a name that both have the right one's value stays. Values are text."""
    a, b = _members(left), _members(right)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b), {"ignoreNullFields": "false"})


def json_without(json: Column, *names: str) -> Column:
    """A flat JSON object without some members. Values are text."""
    return F.to_json(F.map_filter(_members(json), lambda k, _: ~k.isin(*names)), {"ignoreNullFields": "false"})


def json_object_of(name: Column, value: Column) -> Column:
    """An aggregate: a group's names and values as one JSON object, in order of the names; of equal names the greatest value stays."""
    pairs = F.array_sort(F.collect_set(F.struct(name.cast("string").alias("k"), value.cast("string").alias("v"))))
    last = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i + 1)["k"] != p["k"], F.lit(True)))
    return F.to_json(F.map_from_entries(last), {"ignoreNullFields": "false"})


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


#: Phrases of messages by language; a phrase that is not listed is shown as it is.
PHRASES = {"tr": {"SLA missed": "SLA kaçırıldı", "Newly failing in": "Yeni başarısız:", "contracts": "sözleşme", "Contract quality": "Sözleşme kalitesi"}}


def phrase(text: str, language: str = "en") -> str:
    return PHRASES.get(language, {}).get(text, text)
