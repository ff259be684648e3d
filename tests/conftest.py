import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
for p in (ROOT, ROOT / "tests"):
    if str(p) not in sys.path:
        sys.path.insert(0, str(p))

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = compare.session()
    yield s
    s.stop()
