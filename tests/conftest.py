import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("evitrust-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session", autouse=True)
def short_model_runs():
    """Two folds, one seed and small forests while pytest runs; the registered queries keep their full settings, which
    tests/check_oracles.py runs."""
    from evitrust.operators import modeling as M
    from evitrust.plans import model_queries as Q
    Q.FOLDS, Q.SEEDS = 2, (42,)
    Q.MODELS[:] = [M.RunSpec("logistic", c) for c in ("none", "sigmoid", "isotonic", "temperature")] + [
        M.RunSpec("forest", "none", (("trees", 10), ("depth", 5)))]


@pytest.fixture(scope="session")
def sf_dir():
    return SF
