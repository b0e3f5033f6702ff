"""All queries of the page engine by name, with the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.plans import catalogue_queries, filter_queries, layout_queries, page_queries, raster_queries, settings_queries, tone_queries

MODULES = (catalogue_queries, raster_queries, page_queries, tone_queries, settings_queries, filter_queries, layout_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.reg.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.reg.sql.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["content_box_of_pages"](spark, sf_dir)
