import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallychain.session import DEFAULTS

    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    builder = SparkSession.builder.master("local[8]").appName("tests").config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
    made = builder.config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
