"""Bytes, text and strict Base64 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def utf8(column: Column) -> Column:
    """Bytes as text; broken sequences become U+FFFD, as a lenient UTF-8 reader does."""
    return F.make_valid_utf8(column.cast("string"))


def to_utf8(column: Column) -> Column:
    return F.encode(column, "UTF-8")


def whole_number(text: Column) -> Column:
    """A JSON number's text as BIGINT; null unless the number is whole and in range, decided on its digits."""
    part = lambda i: F.regexp_extract(text, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?$", i)
    digits = F.concat(part(1), part(2))
    no_exponent = part(3) == ""
    point = F.length(part(1)) + F.when(no_exponent, 0).otherwise(part(3).try_cast("int"))
    whole = F.when(point <= 0, "").otherwise(F.rpad(F.left(digits, point), F.least(point, F.lit(400)), F.lit("0")))
    fraction = F.when(point <= 0, digits).otherwise(F.substr(digits, point + 1))
    kept = F.ltrim(whole, F.lit("0"))
    sign = F.when(text.startswith("-"), "-").otherwise("")
    number = F.when(kept == "", F.lit(0).cast("bigint")).when(
        F.length(kept) <= 19, F.concat(sign, kept).try_cast("bigint")
    )
    zero = digits.rlike("^0*$")
    return F.when(zero, F.lit(0).cast("bigint")).when((point <= 400) & fraction.rlike("^0*$"), number)


def is_base64(column: Column) -> Column:
    """Strict Base64: no stray characters or line breaks; padding may be left out, but not be wrong."""
    length = F.length(column)
    whole_units = length % 4 == 0
    unpadded = ~column.endswith("=") & (length % 4 != 1)
    return column.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (whole_units | unpadded)


def base64_problem(column: Column) -> Column:
    """Why a text is not strict Base64, or null.

    Fixed values: the messages are those of the JDK's strict decoder, without byte positions.
    """
    stray = F.regexp_extract(column, r"[^A-Za-z0-9+/=]", 0)
    return F.when(
        ~is_base64(column),
        F.when(
            F.length(column) == 1,
            "Input byte[] should at least have 2 bytes for base64 bytes",
        )
        .when(
            stray != "",
            F.concat(
                F.lit("Illegal base64 character "), F.lower(F.hex(F.substring(to_utf8(stray), 1, 1)))
            ),
        )
        .when(
            F.rtrim(column, F.lit("=")).contains("=") | column.endswith("==="),
            "Input byte array has incorrect ending byte",
        )
        .when(column.endswith("="), "Input byte array has wrong 4-byte ending unit")
        .otherwise("Last unit does not have enough valid bits"),
    )


def base64_bytes(column: Column) -> Column:
    """Decoded bytes, null where the text is not Base64. Spark's decoder alone would skip white space."""
    return F.when(is_base64(column), F.unbase64(column))
