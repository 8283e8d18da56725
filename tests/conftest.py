import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cloakwork.session import get_spark

    session = get_spark("tests", "4", "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from cloakwork.plans.registry import Tables

    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def key():
    from cloakwork.functions.keyed import MaskKey

    return MaskKey("test-secret")
