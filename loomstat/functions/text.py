"""Predicates and parsers over string columns, all as Column expressions that stay in the JVM.

Trimming means Unicode white space throughout. A null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = f"{_OCTET}(\\.{_OCTET}){{3}}"
_H = "[0-9a-fA-F]{1,4}"
# All groups, or a run of zero groups left out at each possible place; the last two groups may be an IPv4 address.
_IPV6_PLAIN = "|".join(
    [f"({_H}:){{7}}{_H}"]
    + [f"({_H}:){{{n}}}(:{_H}){{1,{7 - n}}}" for n in range(1, 7)]
    + [f":(:{_H}){{1,7}}", f"({_H}:){{1,7}}:", "::"]
)
_IPV6_MIXED = "|".join(
    [f"({_H}:){{6}}{_IPV4}", f"::({_H}:){{0,5}}{_IPV4}"]
    + [f"({_H}:){{{n}}}:({_H}:){{0,{5 - n}}}{_IPV4}" for n in range(1, 6)]
)
_HEX = "[0-9a-fA-F]"
_UUID_HYPHENS = f"{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}"
_FLOAT = "[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?"
_DATE = "[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_RFC3339 = f"{_DATE}[Tt ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it. Not for the hot path of typed tables."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utrim(s: Column) -> Column:
    return F.regexp_replace(s, "^(?U)\\s+|(?U)\\s+$", "")


def _whole(s: Column, pattern: str) -> Column:
    return s.rlike(f"\\A({pattern})\\z")


def email_like(s: Column) -> Column:
    return _whole(utrim(s), "[^@]+@[^@]*\\.[^@]*")


def ip_like(s: Column) -> Column:
    """Strict IPv4 or IPv6, not trimmed."""
    return _whole(s, f"{_IPV4}|{_IPV6_PLAIN}|{_IPV6_MIXED}")


def uuid_like(s: Column) -> Column:
    """Hyphenated, simple, braced or URN form, not trimmed."""
    return _whole(s, f"{_UUID_HYPHENS}|{_HEX}{{32}}|\\{{{_UUID_HYPHENS}\\}}|urn:uuid:{_UUID_HYPHENS}")


def url_like(s: Column) -> Column:
    return _whole(F.lower(utrim(s)), "(?s)(https?://|www\\.).*")


def json_like(s: Column) -> Column:
    return _whole(utrim(s), "(?s)\\{.*\\}|\\[.*\\]")


def numeric_like(s: Column) -> Column:
    """Parses as a float, infinities and NaN included."""
    return _whole(utrim(s), f"{_FLOAT}|[+-]?(?i)(inf|infinity|nan)")


def boolean_like(s: Column) -> Column:
    return F.lower(utrim(s)).isin("true", "false", "yes", "no", "y", "n", "0", "1")


def hex_like(s: Column) -> Column:
    return _whole(utrim(s), f"(0[xX])?{_HEX}{{4,}}")


def base64_like(s: Column) -> Column:
    t = utrim(s)
    return (F.length(t) >= 8) & (F.length(t) % 4 == 0) & _whole(t, "[A-Za-z0-9+/=]*") & ~t.endswith("===")


def mac_like(s: Column) -> Column:
    return _whole(utrim(s), f"{_HEX}{{2}}(:{_HEX}{{2}}){{5}}|{_HEX}{{2}}(-{_HEX}{{2}}){{5}}")


def zip_like(s: Column) -> Column:
    return _whole(utrim(s), "[0-9]{5}(-[0-9]{4})?")


def date_like(s: Column) -> Column:
    return parse_datetime(s).isNotNull()


def phone_like(s: Column) -> Column:
    t = utrim(s)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    return (digits >= 7) & _whole(t, "[0-9+\\-(). ]*") & t.rlike("[+\\-(). ]") & ~ip_like(t) & ~F.coalesce(date_like(t), F.lit(False))


def ascii_only(s: Column) -> Column:
    return _whole(s, "[\\x00-\\x7F]*")


def whitespace_only(s: Column) -> Column:
    return (F.length(s) > 0) & (utrim(s) == "")


def word_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit("(?U)\\S+")).cast("long")


def parse_datetime(s: Column) -> Column:
    """Timestamp of an RFC 3339 text (as UTC), or of a date (its midnight UTC); null for anything else."""
    t = utrim(s)
    return F.when(_whole(t, _RFC3339), F.try_to_timestamp(F.upper(F.replace(t, F.lit(" "), F.lit("T"))))).when(
        _whole(t, _DATE), t.try_cast("date").cast("timestamp")
    )


#: The counters of a string summary, in report order.
PREDICATES = {
    "date_like": date_like,
    "email_like": email_like,
    "ip_like": ip_like,
    "uuid_like": uuid_like,
    "url_like": url_like,
    "phone_like": phone_like,
    "json_like": json_like,
    "numeric_like": numeric_like,
    "boolean_like": boolean_like,
    "hex_like": hex_like,
    "base64_like": base64_like,
    "mac_address_like": mac_like,
    "zip_code_like": zip_like,
}


def csv_cell(s: Column) -> Column:
    """A CSV cell by its own text: struct<kind, num, is_int, label, str>. Trimmed; empty is null; then boolean, integer
    (up to unsigned 64 bits), finite float, string."""
    low, high = (F.lit(str(x)).cast("decimal(38,0)") for x in (-(2**63), 2**64 - 1))

    def parsed(t: Column) -> Column:
        return F.struct(
            t.alias("t"),
            F.when(_whole(t, "[+-]?[0-9]+"), t.try_cast("decimal(38,0)")).alias("integer"),
            F.when(_whole(t, _FLOAT), t.try_cast("double")).alias("number"),
        )

    def named(p: Column) -> Column:
        kind = (
            F.when(p["t"] == "", "null")
            .when(F.lower(p["t"]).isin("true", "false"), "boolean")
            .when(F.abs(p["number"]) < float("inf"), "number")
            .otherwise("string")
        )
        return F.struct(kind.alias("kind"), F.coalesce(p["integer"].between(low, high), F.lit(False)).alias("is_int"), p.alias("p"))

    def cell(c: Column) -> Column:
        kind, p = c["kind"], c["p"]
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "number", p["number"]).alias("num"),
            c["is_int"].alias("is_int"),
            F.when(kind == "boolean", F.lower(p["t"]))
            .when(c["is_int"], p["integer"].cast("string"))
            .when(kind == "number", p["number"].cast("string"))
            .when(kind == "string", p["t"])
            .alias("label"),
            F.when(kind == "string", p["t"]).alias("str"),
        )

    return let(let(let(F.coalesce(utrim(s), F.lit("")), parsed), named), cell)
