import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from hearthline.session import local_session, release_run_folder

    session = local_session(8, "tests", 4)
    yield session
    release_run_folder(session)


@pytest.fixture(scope="session")
def tables(spark):
    from hearthline.sources.adapter import DerivedListings

    return DerivedListings(spark, SF)
