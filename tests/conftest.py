import datetime as dt
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from driftledger import schemas  # noqa: E402
from driftledger.session import local_session  # noqa: E402

NOW = dt.datetime(2026, 1, 15, 10, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    return local_session(4, **{"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})


@pytest.fixture(scope="session")
def make(spark):
    """make.corpus([...]) and so on: small tables by schema name; short rows are padded with None."""

    class Make:
        def __getattr__(self, name):
            schema = getattr(schemas, name.upper())
            width = len(schema.fields)
            return lambda rows: spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)

        def script(self, target, version, body, direction="up", name="step"):
            return (target, version, direction, f"{version:014d}_{name}.{direction}.sql", body)

    return Make()


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
