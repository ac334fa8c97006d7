"""Field rules of registrations and applications."""

from pyspark.sql import Column, functions as F

# Address syntax and field lengths. \z instead of $: a trailing line break is refused.
ADDRESS = r"^0x[a-fA-F0-9]{40}\z"
PROTOCOL_NAME_MAX = 120
APPLICATION_MAX = {"name": 120, "project": 160, "twitter": 80, "goal": 1000}

EMAIL = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+\z"


def is_address(value: Column) -> Column:
    return F.coalesce(value.rlike(ADDRESS), F.lit(False))


def is_email(value: Column) -> Column:
    return F.coalesce(value.rlike(EMAIL), F.lit(False))


def protocol_errors(name: Column, address: Column) -> Column:
    """Names of the fields that break a rule, as an array."""
    name_bad = F.coalesce(~F.length(name).between(1, PROTOCOL_NAME_MAX), F.lit(True))
    return F.array_compact(
        F.array(F.when(name_bad, F.lit("name")), F.when(~is_address(address), F.lit("address")))
    )


def application_errors(email: Column, fields: dict[str, Column]) -> Column:
    """As ``protocol_errors`` for an application; a missing optional field breaks no rule."""
    broken = [F.when(~is_email(email), F.lit("email"))]
    broken += [F.when(F.length(fields[n]) > m, F.lit(n)) for n, m in APPLICATION_MAX.items() if n in fields]
    return F.array_compact(F.array(*broken))
