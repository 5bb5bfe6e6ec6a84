"""Column functions Spark lacks under these names or with these rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_container(c: str | Column, path: str) -> Column:
    """Whether an object or array stands at the path: by its JSON type, since a string may begin with a bracket too.

    A path with a wildcard gives an array of all that it finds, and is judged by its text.
    """
    if "*" in path:
        return F.ltrim(F.get_json_object(_col(c), path)).rlike(r"^[\[{]")
    found = F.try_variant_get(F.try_parse_json(_col(c)), path, "variant")
    return F.schema_of_variant(found).rlike("^(OBJECT|ARRAY)")


def json_value(c: str | Column, path: str, returning: str = "string", default: object = None) -> Column:
    """Scalar at a JSON path; NULL (or the default) for objects, arrays and failed casts."""
    scalar = F.when(~is_container(c, path), F.get_json_object(_col(c), path))
    value = scalar if returning == "string" else scalar.try_cast(returning)
    return value if default is None else F.coalesce(value, F.lit(default).cast(returning))


def json_query(c: str | Column, path: str) -> Column:
    """Object or array at a JSON path; NULL for scalars."""
    return F.when(is_container(c, path), F.get_json_object(_col(c), path))


def json_exists(c: str | Column, path: str) -> Column:
    """True if the path has a value; a JSON null counts as absent."""
    return F.get_json_object(_col(c), path).isNotNull()


def is_json(c: str | Column) -> Column:
    return F.try_parse_json(_col(c)).isNotNull()


def json_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def json_array(*items: Column) -> Column:
    return F.to_json(F.array(*items))


def truncate(c: str | Column, digits: int = 0) -> Column:
    """Towards zero at ``digits`` decimals."""
    d = _col(c).try_cast("decimal(28,10)")
    scale = F.lit(10 ** digits)
    exact = (F.sign(_col(c)) * F.floor(F.abs(d) * scale) / scale).cast("double")
    # Numbers of more than 18 digits before the point have no decimals to lose, unless digits is negative.
    return F.coalesce(exact, _col(c).cast("double"))


def split_index(c: str | Column, delimiter: str, index: int) -> Column:
    """0-based part of a split string; NULL past the end."""
    parts = F.split(_col(c), _quote(delimiter))
    return F.get(parts, F.lit(index))


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def mask_card(c: str | Column) -> Column:
    card = _col(c)
    return (F.when(card.isNull() | (F.char_length(card) < 8), F.lit("****-****-****-****"))
            .otherwise(F.concat(F.left(card, F.lit(4)), F.lit("-****-****-"), F.right(card, F.lit(4)))))


def mask_email(c: str | Column) -> Column:
    mail = _col(c)
    at = F.instr(mail, "@")
    return (F.when(mail.isNull() | (at <= 2), F.lit("**@***.***"))
            .otherwise(F.concat(F.left(mail, F.lit(2)), F.lit("***"), F.substr(mail, at))))


# The currency codes that are recognised.
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "AUD", "CAD", "SGD")


def normalize_currency(c: str | Column) -> Column:
    code = F.upper(F.trim(_col(c)))
    return F.when(code.isin(*CURRENCIES), code).otherwise(F.lit("UNKNOWN"))


def fmt_duration(seconds: str | Column) -> Column:
    """Seconds as "2h 5m"."""
    s = _col(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"))


def logarithm(c: str | Column, base: float | None = None) -> Column:
    """Natural or other logarithm with -Infinity at 0 and NaN below, where Spark's own gives NULL."""
    v = _col(c).cast("double")
    # the JVM's logarithm of 3 is off by one last digit, and with it every quotient
    value = F.ln(v) if base is None else F.log10(v) if base == 10 else F.ln(v) / F.lit(math.log(base))
    return (F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(value))


def rounded(c: str | Column, digits: int = 0) -> Column:
    """Doubles to ``digits`` decimals as SQL engines on C do: scaled, rounded half away from zero, scaled back.

    Spark's ``round`` takes the shortest decimal text instead, which may end in a half where the scaled number does not, or the other way round:
    368.07866875499997 times 10^8 is 36807866875.5. Scaled values beyond a double's range stay as they are.
    """
    v = _col(c).cast("double")
    scaled = v * F.lit(float(10 ** digits))
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(float(10 ** digits))).otherwise(v)
