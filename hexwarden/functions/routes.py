"""Request paths."""

from pyspark.sql import Column, functions as F

# The entry path of the hosted API and what it stands for.
ENTRY = r"^/api/index(\.py)?"
HEALTH = "/api/health"
API = "/api"


def clean_route(path: Column) -> Column:
    """The route a raw request path was served by."""
    return F.when(path.rlike(ENTRY + r"\z"), F.lit(HEALTH)).otherwise(
        F.regexp_replace(path, ENTRY + "/", "/api/")
    )


def is_api_path(path: Column) -> Column:
    return path.startswith(API)
