import os

import pytest

from corpusmill import session


@pytest.fixture(scope="session")
def spark():
    s = session.build(cpus=min(8, os.cpu_count() or 2), partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
