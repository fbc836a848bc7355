from __future__ import annotations

import pytest

from leadloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield session
    session.stop()


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
