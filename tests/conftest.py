import os

os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest

from terazi.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"
