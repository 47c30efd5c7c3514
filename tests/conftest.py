import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "2",
        "spark.sql.codegen.wholeStage": "false",  # small tables: compiling would take longer than running
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}",
    }
    spark = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
