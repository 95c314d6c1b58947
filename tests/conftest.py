import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

from marlstone.runtime import local_session, ship  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session("4", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(shared), "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(shared / "warehouse")})
    ship(session)
    yield session
    session.stop()
