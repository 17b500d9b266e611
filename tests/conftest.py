import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quireloom.session import local_session

    return local_session("8")
