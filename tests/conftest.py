import pytest

from fleetstream.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def pipe(spark):
    from fleetstream.plans import registry
    from fleetstream.plans.pipeline import Pipeline

    registry.queries()  # registers the stages
    return Pipeline.of(spark, SF)
