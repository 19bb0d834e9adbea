"""Joining, numbers and escapes of annotation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distinct_join(values: Column, by: str = ",") -> Column:
    """Values joined in the order in which they first appear."""
    return F.array_join(F.array_distinct(values), by)


def in_order(order: Column, value: Column) -> Column:
    """Aggregate: the values of a group in the order of a key, nulls left out. The order must be total."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.filter(F.transform(pairs, lambda p: p["v"]), lambda v: v.isNotNull())


def plain_number(x: Column) -> Column:
    """A double as the shortest decimal without an exponent and without a fraction of zero."""
    text = x.cast("string")
    mantissa = F.regexp_extract(text, r"^-?([0-9]+)\.([0-9]+)", 1)
    fraction = F.regexp_replace(F.regexp_extract(text, r"^-?[0-9]+\.([0-9]+)", 1), "0+$", "")
    power = F.coalesce(F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.concat(mantissa, fraction)
    point = F.length(mantissa) + power
    body = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
    )
    whole = F.when(text.contains("E"), body).when(fraction == "", mantissa).otherwise(F.concat(mantissa, F.lit("."), fraction))
    return F.when(text.isin("NaN", "Infinity", "-Infinity"), F.regexp_replace(text, "Infinity", "inf")).otherwise(F.concat(sign, whole))


#: Characters of annotation text that an INFO field escapes.
INFO_SPECIAL = '%;=,|"\\'


def info_escape(c: Column) -> Column:
    """Text for an INFO field: its special characters and all bytes up to 32 or from 127 on as %XX."""
    plain = ~c.rlike(r"""[^!-~]|[%;=,|"\\]""")
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"))
    special = [format(ord(x), "02X") for x in INFO_SPECIAL]
    coded = F.transform(pairs, lambda h: F.when((h <= "20") | (h >= "7F") | h.isin(*special), F.concat(F.lit("%"), h)).otherwise(F.decode(F.unhex(h), "UTF-8")))
    return F.when(plain, c).otherwise(F.array_join(coded, ""))


def info_id(name: str) -> str:
    """A protocol name as an INFO identifier."""
    return "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in name)


def csv_field(c: Column) -> Column:
    """Text for a CSV field: quoted only if it must be."""
    return F.when(c.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def strict_field(c: Column) -> Column:
    """Text for a field of the strict table: quoted if it holds a quote, a tab or a line end."""
    return F.when(c.rlike('["\\t\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
