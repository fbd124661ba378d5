import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from meterlight.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, memory="6g")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("SAMPLE_SMALL", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def medium():
    return os.environ.get("SAMPLE_MEDIUM", "/root/testdata/sf0.01")
