"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from voxframe.session import local_session

    session = local_session(8, "8g", "tests", shared=f"file://{tmp_path_factory.mktemp('shared')}")
    yield session
    session.stop()
