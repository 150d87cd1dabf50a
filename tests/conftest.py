import pytest

from pluvion import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session.local("tests", 8, 8, spark_checkpoint_dir=f"file://{tmp_path_factory.mktemp('shared')}")
    yield s
    s.stop()
