import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    if not os.path.isdir(SF):
        pytest.skip("driver tables not present")
    return SF
