import pytest

from gneiss.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="2g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    spark.sparkContext.setLogLevel("OFF")
    yield spark
    spark.stop()
