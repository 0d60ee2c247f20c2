import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strataline.session import get_session

    s = get_session("tests", "4", 2)
    # on a handful of rows the time goes into compiling plans
    s.conf.set("spark.sql.codegen.wholeStage", "false")
    s.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
