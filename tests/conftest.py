import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stored(spark, tmp_path_factory):
    """(reads that a pileup takes, references) of the smallest tables, derived once and read from files."""
    from strandlight.operators import filters
    from strandlight.plans.fixtures import aln, refs

    folder = tmp_path_factory.mktemp("stored")
    for name, df in (("reads", filters.pileup_mask(aln(spark, "/root/testdata/sf0.001"))), ("refs", refs(spark, "/root/testdata/sf0.001"))):
        df.coalesce(4).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/reads"), spark.read.parquet(f"{folder}/refs")
