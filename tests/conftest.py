import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


GRID = [[1, 1, 2, 2], [1, 1, 2, 2], [1, 3, 3, 3], [3, 3, 4, 4]]


@pytest.fixture(scope="session")
def grid(spark):
    """The golden plane: levels are the values."""
    rows = [(0, 0, y, x, float(v), v) for y, line in enumerate(GRID) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "roi int, z int, y int, x int, val double, g int").cache()
