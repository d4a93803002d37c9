"""Replace personal data by pseudonyms that keep its format.

Numbers and dates are permuted by keyed Feistel networks inside the class that they
belong to: valid card numbers among those with a right check digit, wrong ones among the
wrong ones, account numbers (IBAN), social security numbers and addresses likewise, dates
among the dates whose day is written alike (up to 12, up to 28, beyond). A class is
numbered without gaps, so its permutation is exact: equal values stay linked across
documents and layouts, and different values never get one pseudonym. Mail addresses and
secret tokens have no numeric domain; keyed digests of 64 bits or more stand for them.

Values are read into pairs of numbers, all pairs go through one network, and the moved
pairs are written in each value's own layout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import unused

#: The key of the registered query. Anyone who holds the key can undo the pseudonyms.
KEY = "ledgerlark-demonstration-key"
ROUNDS = 8

_H = "[0-9A-Fa-f]{1,4}"
#: English month names; fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + ")"
#: How the tokens of well-known services begin; fixed values.
PREFIX = "gh[pousr]_|github_pat_|AKIA|ASIA|sk-|xox[abprs]-|AIza|glpat-|eyJ"

#: Kinds in the order in which a place in the text is tried.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z_-])(?:gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255}|A[KS]IA[0-9A-Z]{16}|sk-[0-9A-Za-z_-]{20,255}|xox[abprs]-[0-9A-Za-z-]{24,255}"
    r"|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20,255}|eyJ[0-9A-Za-z_-]{10,4096}\.eyJ[0-9A-Za-z_-]{10,4096}\.[0-9A-Za-z_-]{10,4096})(?![0-9A-Za-z_-])",
    "date": r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-])"
    rf"|(?<!\w)(?:{_MONTH} [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}})(?!\w)",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_H}:){{7}}{_H}|(?:[0-9A-Fa-f]{{4}}|{_H}(?::{_H}){{1,6}})::(?:{_H}(?::{_H}){{0,6}})?)(?![\w:]|\.[0-9])",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w])|(?<![\w+.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![\w-])|(?<![\w+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![\w])",
    "card": r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w])",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _prf(key: str, tweak: Column, i: Column, value: Column) -> Column:
    """60 bits of a keyed digest, below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), value.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(p: Column, key: str) -> Column:
    """A keyed permutation of the pairs (l < a, r < b) of a struct l, r, a, b, tweak."""

    def turn(acc: Column, i: Column) -> Column:
        left = F.struct(F.pmod(acc["l"] + F.pmod(_prf(key, p["tweak"], i, acc["r"]), p["a"]), p["a"]).alias("l"), acc["r"].alias("r"))
        right = F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(_prf(key, p["tweak"], i, acc["l"]), p["b"]), p["b"]).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(p["l"].alias("l"), p["r"].alias("r")), turn)


def _part(left: Column, right: Column, a: Column | int, b: Column | int, tweak: str | Column) -> Column:
    a, b = (F.lit(v) if isinstance(v, int) else v for v in (a, b))
    return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"), (F.lit(tweak) if isinstance(tweak, str) else tweak).alias("tweak"))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once."""
    return F.transform(F.array(value), f)[0]


def _plain(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _digits(s: Column, tweak: str) -> Column:
    """A string of 2 to 36 digits, to be permuted among those of its length."""
    n = F.char_length(s)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10), k).cast("decimal(19,0)").cast("long")
    return _part(F.substr(s, F.lit(1), u), F.substr(s, u + 1), ten(u), ten(n - u), tweak)


def _joined(q: Column, n: Column) -> Column:
    """The n digits that a moved pair stands for."""
    u = F.floor(n / 2).cast("int")
    return F.concat(F.lpad(q["l"].cast("string"), u, "0"), F.lpad(q["r"].cast("string"), n - u, "0"))


def _luhn(s: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.char_length(s)
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substr(s, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when((n - i) % 2 == 1, double(digit(i))).otherwise(digit(i))) % 10


def _into(format_: Column, chars: Column, where: str = "[0-9]") -> Column:
    """format_ with its characters of a class (the digits) replaced one by one."""
    step = lambda acc, c: F.when(c.rlike(where), F.struct(F.concat(acc["s"], F.substr(chars, acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))
    return F.aggregate(F.split(format_, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step, lambda acc: acc["s"])


# Each kind has _read_kind(m), an array of pairs to move, empty where the value does not exist and stays, and
# _write_kind(m, q), the pseudonym by the moved pairs q.


def _read_card(m: Column) -> Column:
    return _once(_plain(m), lambda d: F.array(_digits(F.substr(d, F.lit(1), F.char_length(d) - 1), "card")))


def _write_card(m: Column, q: Column) -> Column:
    """The last digit stays as far from the right check digit as it was: right ones right, wrong ones wrong."""
    given = F.struct(_luhn(_plain(m)).alias("off"), _joined(q[0], F.char_length(_plain(m)) - 1).alias("body"))
    return _once(given, lambda g: _into(m, F.concat(g["body"], F.pmod(10 - _luhn(F.concat(g["body"], F.lit("0"))) + g["off"], F.lit(10)).cast("string"))))


def _lead(m: Column) -> Column:
    """How much of a phone number stays: a plus and the country's first digit."""
    return F.when(m.startswith("+"), 2).otherwise(0)


def _read_phone(m: Column) -> Column:
    return F.array(_digits(_plain(F.substr(m, _lead(m) + 1)), "phone"))


def _write_phone(m: Column, q: Column) -> Column:
    rest = F.substr(m, _lead(m) + 1)
    return F.concat(F.substr(m, F.lit(1), _lead(m)), _into(rest, _joined(q[0], F.char_length(_plain(rest)))))


def _ssn_class(area: Column, group: Column, serial: Column) -> Column:
    """0 for a valid number, else the part that fails: 1 area, 2 group, 3 serial."""
    good = (area > 0) & (area < 900) & (area != 666)
    return F.when(~good, 1).when(group == 0, 2).when(serial == 0, 3).otherwise(0)


def _ssn_parts(m: Column) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    return F.struct(area.alias("a"), group.alias("g"), serial.alias("s"), _ssn_class(area, group, serial).alias("class"))


def _read_ssn(m: Column) -> Column:
    """Numbers are permuted among those of their class."""

    def read(x: Column) -> Column:
        nth = x["a"] - 1 - (x["a"] > 666).cast("int")  # of the 898 good areas
        bad = F.when(x["a"] == 0, 0).when(x["a"] == 666, 1).otherwise(x["a"] - 898)  # of the 102 others
        return (
            F.when(x["class"] == 1, _part(bad, x["g"] * 10_000 + x["s"], 102, 1_000_000, "ssn-area")).when(x["class"] == 2, _part(nth, x["s"], 898, 10_000, "ssn-group"))
            .when(x["class"] == 3, _part(nth, x["g"] - 1, 898, 99, "ssn-serial")).otherwise(_part(nth, (x["g"] - 1) * 9999 + x["s"] - 1, 898, 99 * 9999, "ssn"))
        )

    return F.array(_once(_ssn_parts(m), read))


def _write_ssn(m: Column, q: Column) -> Column:
    left, right = q[0]["l"], q[0]["r"]
    area = left + 1 + (left >= 665).cast("int")
    bad = F.when(left == 0, 0).when(left == 1, 666).otherwise(left + 898)
    code = lambda a, g, s: F.format_string("%03d-%02d-%04d", a, g, s)
    return _once(
        _ssn_parts(m)["class"],
        lambda c: F.when(c == 1, code(bad, F.floor(right / 10_000), right % 10_000)).when(c == 2, code(area, F.lit(0), right))
        .when(c == 3, code(area, right + 1, F.lit(0))).otherwise(code(area, F.floor(right / 9999) + 1, right % 9999 + 1)),
    )


def _ipv4_parts(m: Column) -> Column:
    """v, w (width), padded and n of the four parts; n is how many values a part's form has: 256 plain ones, with leading zeros 10 of width two and 100 of width three."""
    padded = lambda x: x.startswith("0") & (F.char_length(x) > 1)
    forms = lambda x: F.when(~padded(x), 256).when(F.char_length(x) == 2, 10).otherwise(100)
    return F.transform(F.split(m, "[.]"), lambda x: F.struct(x.cast("int").alias("v"), F.char_length(x).alias("w"), padded(x).alias("padded"), forms(x).alias("n")))


def _read_ipv4(m: Column) -> Column:
    one = lambda p: F.array(_part(p[0]["v"] * p[1]["n"] + p[1]["v"], p[2]["v"] * p[3]["n"] + p[3]["v"], p[0]["n"] * p[1]["n"], p[2]["n"] * p[3]["n"], "ipv4"))
    return _once(_ipv4_parts(m), lambda p: F.when(F.forall(p, lambda x: x["v"] < 256), one(p)).otherwise(F.slice(one(p), 1, 0)))


def _write_ipv4(m: Column, q: Column) -> Column:
    """A part with leading zeros stays one of its width."""
    left, right = q[0]["l"], q[0]["r"]

    def write(p: Column) -> Column:
        form = lambda value, i: F.when(p[i]["padded"], F.lpad(value.cast("string"), p[i]["w"], "0")).otherwise(value.cast("string"))
        return F.concat_ws(".", form(F.floor(left / p[1]["n"]), 0), form(left % p[1]["n"], 1), form(F.floor(right / p[3]["n"]), 2), form(right % p[3]["n"], 3))

    return _once(_ipv4_parts(m), write)


def _read_ipv6(m: Column) -> Column:
    """The second half is permuted under a tweak that holds the first."""
    groups = lambda s: F.filter(F.split(s, ":"), lambda x: x != "")
    none = F.array().cast("array<string>")

    def eight(x: Column) -> Column:
        known = F.size(x["left"]) + F.size(x["right"])
        whole = F.when(m.contains("::"), known < 8).otherwise(known == 8)
        return F.when(whole, F.transform(F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), x["right"]), lambda g: F.conv(g, 16, 10).cast("long")))

    def parts(g: Column) -> Column:
        two = lambda i: g[i] * 65_536 + g[i + 1]
        tweak = F.concat_ws("|", F.lit("ipv6"), two(0).cast("string"), two(2).cast("string"))
        both = F.array(_part(two(0), two(2), 1 << 32, 1 << 32, "ipv6"), _part(two(4), two(6), 1 << 32, 1 << 32, tweak))
        return F.when(g.isNotNull(), both).otherwise(F.slice(both, 1, 0))

    halves = F.struct(groups(F.substring_index(m, "::", 1)).alias("left"), F.when(m.contains("::"), groups(F.substring_index(m, "::", -1))).otherwise(none).alias("right"))
    return _once(_once(halves, eight), parts)


def _write_ipv6(m: Column, q: Column) -> Column:
    """Written in full."""
    numbers = F.flatten(F.transform(q, lambda p: F.array(p["l"], p["r"])))
    words = F.flatten(F.transform(numbers, lambda n: F.array(F.floor(n / 65_536).cast("long"), n % 65_536)))
    return F.array_join(F.transform(words, lambda w: F.lower(F.hex(w))), ":")


def _mod97(s: Column) -> Column:
    """A string of digits and capitals read as an IBAN's number, modulo 97."""
    add = lambda acc, c: F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _read_iban(m: Column) -> Column:
    def read(p: Column) -> Column:
        own = F.substr(p, F.lit(5))
        valid = (_mod97(F.concat(own, F.substring(p, 1, 4))) == 1) & (F.char_length(_plain(own)) > 1)
        one = F.array(_digits(F.when(valid, _plain(own)).otherwise("00"), "iban"))
        return F.when(valid, one).otherwise(F.slice(one, 1, 0))

    return _once(F.replace(m, F.lit(" "), F.lit("")), read)


def _write_iban(m: Column, q: Column) -> Column:
    """Country and letters stay, the check digits are worked out anew."""

    def write(p: Column) -> Column:
        country, own = F.substring(p, 1, 2), F.substr(p, F.lit(5))
        new = _into(own, _joined(q[0], F.char_length(_plain(own))))
        return _once(new, lambda o: _into(m, F.concat(country, F.lpad((98 - _mod97(F.concat(o, country, F.lit("00")))).cast("string"), 2, "0"), o), "[^ ]"))

    return _once(F.replace(m, F.lit(" "), F.lit("")), write)


#: Month and day of the days beyond the 28th that every year has, as one number.
_LATE = [m * 100 + d for m in range(1, 13) if m != 2 for d in range(29, 31 + (m in (1, 3, 5, 7, 8, 10, 12)))]


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _valid_date(x: Column) -> Column:
    days = F.when(x["m"] == 2, 28 + _leap(x["y"]).cast("int")).otherwise(31 - (x["m"] - 1) % 7 % 2)
    return (x["y"] > 0) & x["m"].between(1, 12) & (x["d"] >= 1) & (x["d"] <= days)


def _span(y: Column) -> Column:
    """low and years of the 400 years around y: 1800 to 2199 and so on, within 1 to 9999."""
    block = F.floor((y - 200) / 400) * 400 + 200
    low = F.greatest(block, F.lit(1))
    return F.struct(low.cast("int").alias("low"), (F.least(block + 399, F.lit(9999)) - low + 1).cast("int").alias("years"))


def _leaps(s: Column) -> Column:
    return F.filter(F.sequence(s["low"], s["low"] + s["years"] - 1), _leap)


def _found_date(m: Column) -> Column:
    """date (y, m, d) of a match, null where it does not exist, and american. Of aa/bb/yyyy the first is the day where that is a date."""
    names = F.array(*[F.lit(n[:3]) for n in MONTHS])
    date = lambda y, mo, d: F.struct(y.alias("y"), mo.cast("int").alias("m"), d.alias("d"))

    def read(n: Column) -> Column:
        place = F.array_position(names, F.substring(F.regexp_extract(m, "[A-Za-z]+", 0), 1, 3))
        first = F.when(m.rlike("[A-Z]"), date(n[1], place, n[0])).when(m.rlike("^[0-9]{4}"), date(n[0], n[1], n[2])).otherwise(date(n[2], n[1], n[0]))
        return F.struct(first.alias("first"), F.when(m.contains("/"), date(n[2], n[0], n[1])).alias("american"))

    def choose(x: Column) -> Column:
        own = _valid_date(x["first"])
        return F.struct(F.when(own, x["first"]).when(_valid_date(x["american"]), x["american"]).alias("date"), (~own).alias("american"))

    return _once(_once(F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda n: n.cast("int")), read), choose)


def _read_date(m: Column) -> Column:
    """Dates are permuted among those of their class and span, so both or none of day and month are beyond 12 before and after."""

    def read(x: Column) -> Column:
        y, mo, d, s = x["date"]["y"] - x["span"]["low"], x["date"]["m"], x["date"]["d"], x["span"]
        late = F.array(*map(F.lit, _LATE))
        part = (
            F.when(d <= 12, _part(y, (mo - 1) * 12 + d - 1, s["years"], 144, "early")).when(d <= 28, _part(y, (mo - 1) * 16 + d - 13, s["years"], 192, "middle"))
            .when(mo == 2, _part(F.array_position(_leaps(s), x["date"]["y"]) - 1, F.lit(0), F.size(_leaps(s)), 1, "leap"))
            .otherwise(_part(y, F.array_position(late, mo * 100 + d) - 1, s["years"], len(_LATE), "late"))
        )
        return F.filter(F.array(part), lambda p: x["date"].isNotNull())

    return _once(_once(_found_date(m), lambda f: F.struct(f["date"].alias("date"), _span(f["date"]["y"]).alias("span"))), read)


def _write_date(m: Column, q: Column) -> Column:
    """Written as it was; the day and month of a late or leap date come from their lists."""
    months = F.array(*map(F.lit, MONTHS))
    month = F.regexp_extract(m, "[A-Za-z]+", 0)
    two, four = (lambda v, n=n: F.lpad(v.cast("string"), n, "0") for n in (2, 4))
    left, right = q[0]["l"].cast("int"), q[0]["r"].cast("int")

    def moved(f: Column) -> Column:
        d, s = f["date"]["d"], _span(f["date"]["y"])
        date = lambda y, code: F.struct(y.alias("y"), F.floor(code / 100).cast("int").alias("m"), (code % 100).cast("int").alias("d"))
        code = (
            F.when(d <= 12, (F.floor(right / 12) + 1) * 100 + right % 12 + 1).when(d <= 28, (F.floor(right / 16) + 1) * 100 + right % 16 + 13)
            .when(f["date"]["m"] == 2, F.lit(229)).otherwise(F.get(F.array(*map(F.lit, _LATE)), right))
        )
        leap = (d == 29) & (f["date"]["m"] == 2)
        return F.struct(_once(F.struct(F.when(leap, F.get(_leaps(s), left)).otherwise(s["low"] + left).alias("y"), code.alias("code")), lambda c: date(c["y"], c["code"])).alias("date"), f["american"].alias("american"))

    def write(f: Column) -> Column:
        x = f["date"]
        name = F.get(months, x["m"] - 1)
        name = F.when(F.array_contains(months, month), name).otherwise(F.substring(name, 1, 3))
        day = F.when(m.rlike(r"(?:^|\D)0"), two(x["d"])).otherwise(x["d"].cast("string"))
        return (
            F.when(m.contains("/") & f["american"], F.concat_ws("/", two(x["m"]), two(x["d"]), four(x["y"])))
            .when(m.contains("/"), F.concat_ws("/", two(x["d"]), two(x["m"]), four(x["y"]))).when(m.contains("."), F.concat_ws(".", two(x["d"]), two(x["m"]), four(x["y"])))
            .when(month == "", F.concat_ws("-", four(x["y"]), two(x["m"]), two(x["d"])))
            .when(m.rlike("^[0-9]"), F.concat_ws(" ", day, name, four(x["y"]))).otherwise(F.concat(name, F.lit(" "), day, F.lit(", "), four(x["y"])))
        )

    return _once(_once(_found_date(m), moved), write)


def _email(m: Column, key: str) -> Column:
    """Addresses that differ in case only are equal."""
    part = lambda kind, v, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lower(v)), 256), 1, n)
    return F.concat(F.lit("u"), part("mail", m, 32), F.lit("@d"), part("host", F.substring_index(m, "@", -1), 32), F.lit(".example"))


def _secret(m: Column, key: str) -> Column:
    """Runs of hex digits become such runs; a token keeps its service's prefix and its signs."""
    sha = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), *parts), 256)
    run = F.substr(sha(F.lower(m)), F.lit(1), F.char_length(m))
    rest = F.regexp_replace(m, f"^(?:{PREFIX})", "")
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.char_length(m) / 64).cast("int")), lambda i: sha(i.cast("string"), m)), "")
    token = F.concat(F.substr(m, F.lit(1), F.char_length(m) - F.char_length(rest)), _into(rest, stream, "[0-9A-Za-z]"))
    return F.when(m.rlike("^[0-9a-fA-F]{32,64}$"), F.when(m == F.upper(m), F.upper(run)).otherwise(run)).when(m.rlike("^A[KS]IA"), F.upper(token)).otherwise(token)


_PERMUTED = {
    "date": (_read_date, _write_date), "ipv6": (_read_ipv6, _write_ipv6), "ipv4": (_read_ipv4, _write_ipv4), "ssn": (_read_ssn, _write_ssn),
    "iban": (_read_iban, _write_iban), "phone": (_read_phone, _write_phone), "card": (_read_card, _write_card),
}
_DIGESTED = {"email": _email, "secret": _secret}


def kind_of(m: Column) -> Column:
    """The kind of a match: the first pattern that fits all of it."""
    out = F.lit(None).cast("string")
    for kind in reversed(PATTERNS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def _by_kind(kind: Column, made: dict[str, Column], other: Column) -> Column:
    for k, column in made.items():
        other = F.when(kind == k, column).otherwise(other)
    return other


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with text replaced by its pseudonymised form, plus pii: how many values of each kind were replaced.

    Null texts stay null, with no values; a text without any is unchanged, an empty table
    stays empty. Dates, addresses and account numbers that do not exist (31 February,
    300.1.1.1) are left as they are, and nothing is mapped on them; digit runs that
    fail the card check are permuted among such runs. Every row is handled on its own and
    as a whole, however long, so repeated rows and ties come out alike and nothing is
    shuffled. Other columns of docs stay; where one is named pii, the counts are named pii_.
    """
    work, counts = unused(docs, "_work"), unused(docs, "pii")
    # Tokens without a digit begin with one of their prefixes.
    may = F.col("text").rlike("[0-9@]")
    for prefix in ("_", "AKIA", "ASIA", "sk-", "xox", "AIza", "glpat-", "eyJ"):
        may = may | F.col("text").contains(prefix)
    found = F.when(may, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    values = docs.select(*kept, F.transform(F.get(F.filter(F.array(found), lambda f: F.size(f) > 0), F.lit(0)), lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))).alias(work))

    none = F.slice(F.array(_part(F.lit(0), F.lit(0), 1, 1, "")), 1, 0)
    read = lambda x: _by_kind(x["kind"], {k: f(x["m"]) for k, (f, _) in _PERMUTED.items()}, none)
    values = values.select(*kept, F.transform(work, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), read(x).alias("pairs"))).alias(work))
    moved = lambda x: F.transform(x["pairs"], lambda p: feistel(p, key))
    values = values.select(*kept, F.transform(work, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), moved(x).alias("pairs"))).alias(work))

    def write(x: Column) -> Column:
        made = {k: F.when(F.size(x["pairs"]) > 0, f(x["m"], x["pairs"])).otherwise(x["m"]) for k, (_, f) in _PERMUTED.items()}
        return _by_kind(x["kind"], made | {k: f(x["m"], key) for k, f in _DIGESTED.items()}, x["m"])

    values = values.select(*kept, F.transform(work, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), write(x).alias("new"))).alias(work))

    between = F.split("text", _ANY, -1)
    text = F.array_join(F.zip_with(between, F.concat(F.col(f"{work}.new"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    text = F.when(F.col(work).isNotNull(), text).otherwise(F.col("text"))

    def count(kind: str) -> Column:
        of_kind = F.filter(work, lambda x: (x["kind"] == kind) & (x["new"] != x["m"]))
        return F.coalesce(F.when(F.col(work).isNotNull(), F.size(of_kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    number = F.struct(*map(count, PATTERNS)).alias(counts)
    return values.select(*[text.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns], number)


def op10(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text")).select("doc_id", "text", "pii.*")
