"""Which columns hold personal data, judged by what their values look like, and where such values stand in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.expressions import is_citizen_number, is_tax_number

#: A column is personal where this share of its values is of some kind; of those kinds the ones with this share are named.
GATE, SHARE = 0.8, 0.1


def recognisers(v: Column) -> dict[str, Column]:
    """Kinds in order of preference, for a trimmed value."""
    octets = v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")
    return {
        "EMAIL_ADDRESS": v.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"),
        "TR_NATIONAL_ID": is_citizen_number(v),
        "TR_VKN": is_tax_number(v),
        "IBAN_CODE": v.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"),
        "CREDIT_CARD": v.rlike(r"^[0-9]{13,19}$") & luhn(v),
        "IP_ADDRESS": octets,
        "PHONE_NUMBER": v.rlike(r"^\+?[0-9 ()-]{7,20}$") & (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 7) & ~v.rlike("^[0-9]+$"),
    }


def luhn(v: Column) -> Column:
    n = F.char_length(v)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(v, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def kind_of(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, fits in reversed(recognisers(F.trim(v)).items()):
        out = F.when(fits, name).otherwise(out)
    return out


def shares(values: DataFrame) -> DataFrame:
    """table_name, column_name, kind, share, classified of values (table_name, column_name, value); kinds under SHARE are left out."""
    kinds = values.where("value is not null").groupBy("table_name", "column_name", kind_of(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return _shares(kinds)


def _shares(kinds: DataFrame) -> DataFrame:
    whole = kinds.groupBy("table_name", "column_name").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("kind").isNotNull(), F.col("n")).otherwise(0)).alias("known"))
    rows = kinds.where("kind is not null").join(whole, ["table_name", "column_name"])
    out = rows.select("table_name", "column_name", "kind", (F.col("n") / F.col("all")).alias("share"), (F.col("known") / F.col("all") >= GATE).alias("classified"))
    return out.where(F.col("share") >= SHARE)


def long_values(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """table_name, column_name, value: the columns' values under each other as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.lit(table).alias("table_name"), F.inline(cells))


# --- spans in free text

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: What a kind looks like inside a text, and how sure it is by its looks alone; kinds with check digits are certain where these are right, and nothing where they are wrong.
PATTERNS = {
    "EMAIL_ADDRESS": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0.9),
    "IP_ADDRESS": (rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])", 0.6),
    "PHONE_NUMBER": (r"(?<![0-9A-Za-z+.@-])\+?[0-9(][0-9 ()-]{5,18}[0-9](?![0-9A-Za-z@])", 0.4),
    "IBAN_CODE": (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 1.0),
    "CREDIT_CARD": (r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])", 1.0),
    "TR_NATIONAL_ID": (r"(?<![0-9])[1-9][0-9]{10}(?![0-9])", 1.0),
    "TR_VKN": (r"(?<![0-9])[0-9]{10}(?![0-9])", 1.0),
}


def is_iban(v: Column) -> Column:
    """Whether the number that an account number stands for leaves 1 by 97: its first four characters last, letters as 10 to 35."""
    turned = F.split(F.concat(F.substr(v, F.lit(5)), F.substring(v, 1, 4)), "")
    letter = lambda c: F.ascii(c) - 55
    rest = F.aggregate(turned, F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + letter(c)) % 97))
    return rest == 1


def _right(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    return {
        "IBAN_CODE": lambda: is_iban(v), "CREDIT_CARD": lambda: luhn(digits), "TR_NATIONAL_ID": lambda: is_citizen_number(v), "TR_VKN": lambda: is_tax_number(v),
        "PHONE_NUMBER": lambda: F.length(digits).between(7, 15) & ~v.rlike("^[0-9]+$"),
    }.get(kind, lambda: F.lit(True))()


def _matches(text: Column, kind: str, pattern: str, score: float) -> Column:
    """The valid spans of one kind. What lies between matches tells where each begins."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def length(parts: Column, n: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda t, x: t + F.length(x))

    def span(v: Column, i: Column) -> Column:
        at = length(gaps, i + 1) + length(values, i)
        return F.struct(at.alias("at"), (at + F.length(v)).alias("until"), F.lit(kind).alias("kind"), F.lit(score).alias("score"), v.alias("value"))

    return F.filter(F.transform(values, span), lambda s: _right(kind, s["value"]))


def spans(text: Column) -> Column:
    """The personal values in a text as structs (at, until, kind, score, value), at from 0, until behind the last character.

    Of spans that overlap, those stay that no better one overlaps: of higher score, then
    longer, then earlier, then first by kind. Null has none. All is one expression, so texts
    are not shuffled; it is meant for cells and messages, as a text's matches meet each other.
    """
    every = F.concat(*[_matches(text, kind, *of) for kind, of in PATTERNS.items()])

    def better(a: Column, b: Column) -> Column:
        size = lambda s: s["until"] - s["at"]
        rank = lambda s: F.struct(-s["score"], -size(s), s["at"], s["kind"])
        return (a["at"] < b["until"]) & (b["at"] < a["until"]) & (rank(a) < rank(b))

    return F.array_sort(F.filter(every, lambda s: ~F.exists(every, lambda t: better(t, s))))


def text_shares(values: DataFrame) -> DataFrame:
    """shares() of values that hold something personal anywhere: each counts for the kind of its best span."""
    best = F.element_at(F.array_sort(F.transform(spans(F.col("value")), lambda s: F.struct(-s["score"], s["at"], s["kind"]))), 1)
    kinds = values.where("value is not null").withColumn("kind", F.when(F.size(spans(F.col("value"))) > 0, best["kind"]))
    counts = kinds.groupBy("table_name", "column_name", "kind").agg(F.count(F.lit(1)).alias("n"))
    return _shares(counts)
