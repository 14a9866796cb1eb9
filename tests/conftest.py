import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from histlens.session import session

    folder = tmp_path_factory.mktemp("spark")
    made = session("tests", "local[4]", 4, spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__warehouse__dir=str(folder / "warehouse"), spark__checkpoint__dir=str(folder / "checkpoints"), spark__sql__adaptive__coalescePartitions__enabled="true")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    if not Path(SMALL).exists():
        pytest.skip("no test tables here")
    return SMALL
