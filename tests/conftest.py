import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from skein.session import build_session

    # interpreted plans: compiling them takes longer than running them on a few rows
    s = build_session("local[4]", partitions=2, spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
