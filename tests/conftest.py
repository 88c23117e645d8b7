import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from pagelens.session import get_spark


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", "4")
