"""Text shaping: cutting, shortening, escaping, rendering."""

from pyspark.sql import Column, functions as F

# How much text is kept.
INPUT_CHARS = 500
SUMMARY_CHARS = 120
KEY_PREFIX_CHARS = 9
LOG_HASH_CHARS = 18

# The white space of Unicode, and the control characters that count as such.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Shown in place of a missing or empty text.
NO_VALUE = "—"
DEFAULT_ALERT_TEXT = "High risk transaction detected"
UNKNOWN_PROTOCOL = "Unknown"

# Fixed value: a Markdown code fence, optionally tagged json; the shortest one, over line breaks.
FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def cut(value: Column, chars: int) -> Column:
    """First ``chars`` characters; a missing text becomes empty."""
    return F.substring(F.coalesce(value, F.lit("")), 1, chars)


def strip(value: Column) -> Column:
    """Remove all white space of Unicode at both ends (``trim`` by itself only removes blanks)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def unfence(value: Column) -> Column:
    """The inside of the first code fence, or the whole text; stripped."""
    fenced = value.contains("```") & value.rlike(FENCE)
    return strip(F.when(fenced, F.regexp_extract(value, FENCE, 1)).otherwise(value))


def shorten(value: Column, head: int = 10, tail: int = 6, empty: str = NO_VALUE, keep_upto: int = 0) -> Column:
    """``head...tail`` form of a hash, address or key; texts of at most ``keep_upto`` stay whole."""
    short = F.concat(F.substring(value, 1, head), F.lit("..."), F.right(value, F.lit(tail)))
    return (
        F.when(F.coalesce(value, F.lit("")) == "", F.lit(empty))
        .when(F.length(value) <= keep_upto, value)
        .otherwise(short)
    )


def mask_key(value: Column) -> Column:
    return shorten(value, head=KEY_PREFIX_CHARS)


def log_hash(value: Column) -> Column:
    return F.substring(value, 1, LOG_HASH_CHARS)


def email_domain(email: Column) -> Column:
    return F.element_at(F.split(email, "@"), -1)


def fixed_decimals(value: Column, places: int) -> Column:
    """A non-negative double (up to 2^62) with ``places`` decimals, rounded from its exact binary value, halves up.

    ``format_string`` would round the shortest decimal text instead and differ on apparent ties. The
    fraction is exact after removing the whole part; times 2^63 it is an integer.
    """
    value = F.coalesce(value, F.lit(0.0))
    whole = F.floor(value)
    units = F.floor((value - whole) * F.lit(2.0**63)).cast("decimal(19,0)")
    scale = 10**places
    rounded = F.call_function("div", units * F.lit(2 * scale) + F.lit(2**63 - 1) + F.lit(1), F.lit(2**62) * F.lit(4).cast("decimal(20,0)"))
    total = whole * F.lit(scale) + rounded
    return F.concat(
        F.call_function("div", total, F.lit(scale)).cast("string"),
        F.lit("."),
        F.lpad((total % F.lit(scale)).cast("string"), places, "0"),
    )


def escape_html(value: Column) -> Column:
    """Escape the five HTML characters, ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def alert_text(summary: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.lit(DEFAULT_ALERT_TEXT))


def alert_message(protocol_name: Column, risk_score: Column, tx_hash: Column) -> Column:
    """HTML message of one alert."""
    name = F.coalesce(protocol_name, F.lit(UNKNOWN_PROTOCOL))
    score = F.coalesce(risk_score.cast("string"), F.lit("None"))
    # Message headings.
    return F.concat(
        F.lit("<b>🚨 New Risk Alert 🚨</b>\n\n<b>Protocol:</b> "),
        escape_html(name),
        F.lit("\n<b>Score:</b> <code>"),
        score,
        F.lit("</code>\n<b>TX:</b> <code>"),
        escape_html(F.coalesce(tx_hash, F.lit(""))),
        F.lit("</code>"),
    )


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("unknown"))


def scoring_request(
    protocol_name: Column,
    protocol_address: Column,
    tx_hash: Column,
    from_address: Column,
    to_address: Column,
    value_eth: Column,
    gas_used: Column,
    input_data: Column,
    block_number: Column,
) -> Column:
    """The text put to a score provider for one transaction; missing fields read ``unknown``."""
    lines = [
        F.concat(F.lit("Watched contract: "), _shown(protocol_name), F.lit(" at "), _shown(protocol_address)),
        F.concat(F.lit("Hash: "), _shown(tx_hash)),
        F.concat(F.lit("Sender: "), _shown(from_address)),
        F.concat(F.lit("Recipient: "), _shown(to_address)),
        F.concat(F.lit("Amount in ETH: "), _shown(value_eth)),
        F.concat(F.lit("Gas: "), _shown(gas_used)),
        F.concat(F.lit("Call data: "), cut(input_data, INPUT_CHARS)),
        F.concat(F.lit("Block number: "), _shown(block_number)),
    ]
    return F.concat_ws("\n", *lines)
