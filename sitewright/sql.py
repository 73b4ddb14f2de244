"""The engine's Python functions for SQL: what Spark's own functions cannot express (URLs as browsers read them, HTML, robots)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import urls
from .sources import html, robots


def register(spark: SparkSession) -> None:
    """Registers url_parts(url, base), url_normal(url, base), html_parts(html) and robots_rules(text), each giving a struct."""
    spark.udf.register("url_parts", F.pandas_udf(urls._parse, urls.URL))
    spark.udf.register("url_normal", F.pandas_udf(urls._parse_normal, urls.URL))
    spark.udf.register("html_parts", F.pandas_udf(html._extract, html.RAW))
    spark.udf.register("robots_rules", F.pandas_udf(robots._parse, robots.RULES))
