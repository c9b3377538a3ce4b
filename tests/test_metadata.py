"""Signals of a track header."""
from pyspark.sql import functions as F

from portcullis.operators import metadata as M


def test_header_map_is_built_once(spark):
    """The map of a header is no expression of each key that is looked up."""
    props = F.create_map(F.lit("color_primaries"), F.format_string("%d", F.col("id")))
    df = spark.range(3).select(M.header_groups(props).alias("h")).select("h.primaries")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 1
