import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check_oracle import SMALL, session

from shapescreen.session import ship_package


@pytest.fixture(scope="session")
def spark():
    spark = session(8)
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def molecules(spark):
    from shapescreen.sources import embeddings
    from shapescreen.sources.store import stage

    return stage(embeddings.molecules(spark, SMALL), "molecules")


@pytest.fixture(scope="session")
def dataset(spark, molecules):
    from shapescreen.operators.models import as_dataset
    from shapescreen.sources.store import stage

    return stage(as_dataset(molecules.filter("target < 2")), "dataset")
