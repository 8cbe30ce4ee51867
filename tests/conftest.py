import os
import sys
from pathlib import Path

import pytest

# the workers import this repository and functions of test modules too
_HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(_HERE.parent))
os.environ["PYTHONPATH"] = ":".join([str(_HERE.parent), str(_HERE), str(_HERE / "llm"), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
