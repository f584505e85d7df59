from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quasi.session import local_session

    session = local_session(
        "tests", os.environ.get("BENCH_CPUS", "8"), spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared"))
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("QUASI_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("test tables not present")
    return path
