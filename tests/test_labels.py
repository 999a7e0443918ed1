from pyspark.sql import functions as F

from meterlake.functions import exprs as E
from meterlake.functions import labels


def test_names_and_formats(spark):
    df = spark.createDataFrame([("dsh", 90_061_000, 1234.5), ("new", 3_600_000, 0.004)], "app string, ms long, usd double")
    got = df.select(labels.shown(F.col("app"), labels.APP_NAMES), labels.until(F.col("ms"), 0), E.fmt_duration(F.col("ms")), E.fmt_usd(F.col("usd")), E.fmt_compact(F.col("ms")), E.pct_decode(F.lit("a%20b+c%zz"))).collect()
    assert tuple(got[0]) == ("DeepSeek Harness", "1d 01h", "25h 01m", "$1,234.50", "90.1M", "a b+c%zz")
    assert tuple(got[1]) == ("new", "1h 00m", "1h 00m", "$0.0040", "3.6M", "a b+c%zz")
