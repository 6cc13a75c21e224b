"""Queries whose workers cannot import the package."""

import os
import subprocess
import sys
from pathlib import Path

from tests.conftest import SF

RUN = """
import sys
sys.path.insert(0, sys.argv[1])
from laurel.llm import queries
from laurel.session import session
spark = session(4, "3g", 4, **{"spark.checkpoint.dir": sys.argv[3] + "/shared", "spark.sql.warehouse.dir": sys.argv[3] + "/warehouse"})
def absent(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("laurel") is None
        yield batch
spark.range(4).mapInArrow(absent, "id long").collect()
for name, query in queries.QUERIES.items():
    if name.split("_")[0] in ("op4", "op5", "op6", "op9", "op11", "op12", "op13"):
        assert query(spark, sys.argv[2]).count() > 0
print("all ran")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", RUN, repo, SF, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in done.stdout, done.stderr[-3000:]
