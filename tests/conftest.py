import pytest

from propflow.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "local[8]",
        "propflow-tests",
        **{
            "spark.checkpoint.dir": folder,
            "spark.sql.warehouse.dir": f"{folder}/warehouse",
            "spark.driver.memory": "6g",
        },
    )
    yield session
    session.stop()
