"""SQL names of the functions. Registering again replaces them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geoledger.functions.contours import generate_contours
from geoledger.functions.curves import curved_to_linear
from geoledger.functions.wkb import geometry_type_hex_sql, geometry_type_sql, strip_srid_sql


def register_geometry_type(spark: SparkSession) -> None:
    """get_wkb_geom_type(binary) and get_wkb_geom_type_hex(string), both native SQL functions."""
    spark.sql(f"create or replace temporary function get_wkb_geom_type(w binary) returns string return {geometry_type_sql('w')}")
    spark.sql(f"create or replace temporary function get_wkb_geom_type_hex(w string) returns string return {geometry_type_hex_sql('w')}")


def register_curves(spark: SparkSession) -> None:
    """curved_to_linear_wkb(binary [, degrees]) and the native wkb_strip_srid(binary)."""
    spark.udf.register("curved_to_linear_wkb", curved_to_linear)
    spark.sql(f"create or replace temporary function wkb_strip_srid(w binary) returns binary return {strip_srid_sql('w')}")


def register_contours(spark: SparkSession) -> None:
    """generate_contours_udf(raster, interval, base)."""
    spark.udf.register("generate_contours_udf", generate_contours)


def register_all(spark: SparkSession) -> None:
    register_geometry_type(spark)
    register_curves(spark)
    register_contours(spark)
