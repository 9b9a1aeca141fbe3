import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import local_session, ship

    session = local_session("tests", 8, **{"spark.driver.memory": "8g"})
    ship(session)
    return session
