import pytest

from tests.comparing import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session()
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return session
