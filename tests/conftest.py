import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark():
    from brindle.session import session

    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SAMPLE = """id,name,age,city,score
1,Ann,34,Hollywood,9.5
2,Bob,28,Central,7.25
3,Cid,45,Hollywood,8.0
4,Dee,31,Pacific,6.75
5,Eve,29,Central,9.0
6,Fay,,Hollywood,
7,Gus,52,N Hollywood,5.5
8,Hal,41,Pacific,8.25
9,Ivy,37,Central,7.0
10,Jon,33,Hollywood,8.5
"""


@pytest.fixture
def engine(spark, tmp_path):
    from brindle.plans.engine import Engine

    return Engine(spark, f"file://{tmp_path}/root")


@pytest.fixture
def sample_csv(tmp_path):
    p = tmp_path / "sample.csv"
    p.write_text(SAMPLE)
    return str(p)
