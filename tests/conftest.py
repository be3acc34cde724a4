import os
import shutil
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
# tasks import the package as well
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestream.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    session = build_session("tests", "local[4]", **{"spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{shared}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def scratch_ends_with_its_test(request):
    """Tables that a test's queries wrote go with it; the session-wide ones are none of theirs."""
    yield
    if "spark" in request.fixturenames:
        spark = request.getfixturevalue("spark")
        for part in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("*"):
            shutil.rmtree(part, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
