"""The request log: cleaning and appending."""

from pyspark.sql import DataFrame, functions as F

from hexwarden.functions.routes import clean_route, is_api_path


def loggable(requests: DataFrame) -> DataFrame:
    """Requests that belong in the log: those to the API. The raw path is kept."""
    return requests.filter(is_api_path(F.col("endpoint")))


def with_routes(request_log: DataFrame) -> DataFrame:
    """Add ``route``, the path a request was served by."""
    return request_log.withColumn("route", clean_route(F.col("endpoint")))


def requests_per_route(request_log: DataFrame) -> DataFrame:
    return with_routes(request_log).groupBy("route", "method").agg(F.count(F.lit(1)).alias("requests"))
