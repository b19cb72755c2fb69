import os
import sys
from datetime import date, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickersift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", "tests", 8, str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Bars from (symbol, session number, close) tuples; other columns may be overridden per row."""

    def make(rows, **columns):
        from decimal import Decimal

        monday = date(2020, 1, 6)
        data = []
        for row in rows:
            symbol, sess, close = row[:3]
            extra = row[3] if len(row) > 3 else {}
            bar = {
                "symbol": symbol,
                "bar_date": monday + timedelta(days=sess),
                "open": close,
                "high": close,
                "low": close,
                "close": close,
                "tor": 10.0,
                "pct_chg": 0.0,
                **columns,
                **extra,
            }
            for c in ("open", "high", "low", "close"):
                bar[c] = None if bar[c] is None else Decimal(str(bar[c]))
            data.append(tuple(bar[c] for c in ("symbol", "bar_date", "open", "high", "low", "close", "tor", "pct_chg")))
        price = "decimal(18,2)"
        schema = (
            f"symbol string, bar_date date, open {price}, high {price}, low {price}, close {price}, "
            "tor double, pct_chg double"
        )
        return spark.createDataFrame(data, schema)

    return make
