import sys
from datetime import date, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tapeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", "tapeloom-tests", 4)
    yield s
    s.stop()


@pytest.fixture
def path_bars(spark):
    """Bars from close paths: {symbol: [close, ...]}; high 1% over and low 1% under the close."""

    def make(paths, volume=1000):
        rows = [
            (sym, date(2024, 1, 1) + timedelta(days=i), c, c * 1.01, c * 0.99, c, c, volume)
            for sym, path in paths.items()
            for i, c in enumerate(map(float, path))
        ]
        return spark.createDataFrame(
            rows,
            "symbol string, date date, open double, high double, low double, close double, close_adj double, volume long",
        )

    return make
