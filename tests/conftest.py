import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from wattframe.session import build_session

    s = build_session(
        "tests",
        "local[8]",
        spark_sql_shuffle_partitions=4,
        spark_ui_enabled="false",
        spark_ui_showConsoleProgress="false",
        spark_driver_memory="6g",
        spark_python_sql_dataFrameDebugging_enabled="false",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
