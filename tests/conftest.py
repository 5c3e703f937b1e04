import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from ctxspark.session import ensure_checkpoint_dir, local_session

    session = local_session(4, shuffle_partitions=4, driver_memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    ensure_checkpoint_dir(session)
    yield session
    session.stop()
