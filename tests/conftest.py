import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[*]").appName("tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def bars(spark, small):
    """Half-hour bars of the test events, stored once."""
    from barloom.sources.adapters import stored_bars
    return stored_bars(spark, small)


@pytest.fixture(scope="session")
def bars_pd(bars):
    return bars.orderBy("ticker", "session", "bar_ts").toPandas()
