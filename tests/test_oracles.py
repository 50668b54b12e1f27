"""Every query of the catalogue against its SQL on the smallest data."""

from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from lumenshelf.queries import ORACLES, QUERIES


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        if isinstance(v, float | np.floating) and not float(v).is_integer():
            return f"{v:.9g}"
        # Integers are compared exactly, also where one side has them as whole floats.
        return str(v) if isinstance(v, bool | str) else str(int(v)) if isinstance(v, int | float | np.number | Decimal) and v == int(v) else str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got.columns)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registry_needs_no_session():
    """queries() and oracle_sql() are asked for before a session exists."""
    import subprocess
    import sys
    from pathlib import Path

    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
