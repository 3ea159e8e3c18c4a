import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pagetrail.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def apply(spark):
    """apply(function of Columns, rows of arguments) -> list of results, in one Spark job."""
    from pyspark.sql import functions as F

    def run(function, rows, types=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        types = types or ["string"] * len(rows[0])
        schema = "i int, " + ", ".join(f"a{k} {t}" for k, t in enumerate(types))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", function(*[F.col(f"a{k}") for k in range(len(types))]).alias("r")).collect()
        return [r["r"] for r in sorted(out, key=lambda r: r["i"])]

    return run
