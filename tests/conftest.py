import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from semdex.session import get_spark
    extra = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
             "spark.driver.memory": "8g"}
    s = get_spark("local[*]", 8, extra=extra)
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="semdex-test-ckpt-"))
    yield s
