import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from parley.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "parley-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", 5000)  # plans are read in full
    yield session
    session.stop()


@pytest.fixture
def people(spark):
    """U1 Ann, U2 Bob, U4 without names, and channel C2."""
    users = spark.createDataFrame(
        [("U1", "Ann", "ann1", "Ann A.", False), ("U2", "Bob", "bob1", None, False),
         ("U3", None, "cy", "Cy Real", False), ("U4", None, None, None, True)],
        "slack_id string, name string, display_name string, real_name string, is_bot boolean",
    )
    channels = spark.createDataFrame([("C2", "dev", False), ("C3", "dev-ops", True)], "slack_id string, name string, is_private boolean")
    return users, channels
