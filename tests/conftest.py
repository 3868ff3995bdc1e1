import os
import sys
from pathlib import Path

import pytest

HERE = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lanternlog.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "4g"})
    yield session
    session.stop()
