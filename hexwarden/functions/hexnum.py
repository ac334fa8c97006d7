"""Hex text to exact numbers, as column expressions.

Spark's ``conv`` stops silently at a character it does not know (the ``x`` of ``0x10`` included) and
raises beyond 64 bits, so texts are checked first, and wide values are put together from two halves.
Text that is not hex, or too wide, gives null; ``is_undecodable`` tells that apart from a missing value.
No regular expressions here: these run on every field of every transaction.
"""

from decimal import Decimal

from pyspark.sql import Column, functions as F

WEI_PLACES = 18
_TWO_64 = Decimal(2**64)
_ANY_LENGTH = 2**31 - 1


def or_default(value: Column, default) -> Column:
    """``default`` for null and for the empty value ('' for text, 0 for a number)."""
    empty = "" if isinstance(default, str) else 0
    return F.coalesce(F.nullif(value, F.lit(empty)), F.lit(default))


def digits(value: Column) -> Column:
    """The digits behind ``0x``, without leading zeros; null for a text without any digit."""
    prefixed = value.startswith("0x") | value.startswith("0X")
    body = F.when(prefixed, F.substring(value, 3, _ANY_LENGTH)).otherwise(value)
    return F.when(~value.isin("", "0x", "0X"), F.ltrim(body, F.lit("0")))


def _padded(digits: Column, width: int) -> Column:
    padded = F.lpad(digits, width, "0")
    # unhex gives null for any character that is no hex digit.
    return F.when((F.length(digits) <= width) & F.unhex(padded).isNotNull(), padded)


def _number(padded: Column) -> Column:
    return F.conv(padded, 16, 10)


def long_of(digits: Column) -> Column:
    """``digits`` as bigint; null if not hex or above 2^63-1."""
    return _number(_padded(digits, 16)).try_cast("bigint")


def wei_of(digits: Column) -> Column:
    """``digits`` as decimal(38,0), exact; null if not hex or at 10^38 and above."""
    padded = _padded(digits, 32)
    high = _number(F.substring(padded, 1, 16)).cast("decimal(20,0)")
    low = _number(F.substring(padded, 17, 16)).cast("decimal(20,0)")
    return F.try_add(F.try_multiply(high, F.lit(_TWO_64)), low).cast("decimal(38,0)")


def hex_to_long(value: Column) -> Column:
    """Hex text to bigint in one expression; where many rows are decoded, make ``digits`` a column first."""
    return long_of(digits(value))


def hex_to_wei(value: Column) -> Column:
    """Hex text to decimal(38,0) in one expression."""
    return wei_of(digits(value))


def wei_to_eth(wei: Column) -> Column:
    """Wei to ETH as the double nearest to the exact quotient.

    The decimal point is moved in the text, so the value is rounded once, by the cast.
    """
    text = F.lpad(wei.cast("string"), 38, "0")
    whole, part = F.substring(text, 1, 38 - WEI_PLACES), F.substring(text, 39 - WEI_PLACES, WEI_PLACES)
    return F.concat(whole, F.lit("."), part).cast("double")


def gas_amount(text: Column) -> Column:
    """Gas as bigint. Text without a ``0x`` is a JSON number: kept as it is."""
    return F.coalesce(F.when(~F.lower(text).startswith("0x"), text.try_cast("bigint")), hex_to_long(text))


def is_given(text: Column) -> Column:
    """Neither null, nor empty, nor the JSON number 0."""
    return text.isNotNull() & ~text.isin("", "0")


def is_undecodable(source: Column, decoded: Column) -> Column:
    """True where a text was given but no number came out: such rows belong in quarantine."""
    return source.isNotNull() & (source != "") & decoded.isNull()
