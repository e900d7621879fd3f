import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tessella-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
__spark_entry__.queries()[sys.argv[2]](spark, sys.argv[3]).write.format("noop").mode("overwrite").save()
"""


@pytest.fixture
def alone(tmp_path):
    """Runs a query in a process of its own, from another folder and without the repository in PYTHONPATH."""
    import subprocess

    def run(name, data="/root/testdata/sf0.001"):
        if not os.path.isdir(data):
            pytest.skip("no tables")
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        done = subprocess.run([sys.executable, "-c", ALONE, top, name, data], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr[-2000:]

    return run
