import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scanloom.session import local_session

    session = local_session("8", 8)
    if session.conf.get("spark.checkpoint.dir", None) is None:
        folder = str(tmp_path_factory.mktemp("checkpoints"))
        session.sparkContext.setCheckpointDir(folder)
    yield session
    session.stop()
