"""The operators away from the repository: no package on the workers' path, no Spark settings of the machine."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = f"""
import sys

sys.path.insert(0, {ROOT!r})
from parley.llm import decontaminate, pii, simhash
from parley.session import clean_scratch, local_session, shared_dir

spark = local_session(2, "away", 2)
docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "mail me at x@y.org")], "doc_id long, text string")
assert [r.component_id for r in simhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 3]
items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
assert decontaminate.clean(docs, items).count() == 1
assert sorted(r.n_email for r in pii.findings(docs).collect()) == [0, 0, 1]
assert shared_dir(spark) == shared_dir(spark)
clean_scratch(spark)
spark.stop()
print("all well")
"""


def test_tasks_need_no_installed_package_and_no_settings(tmp_path):
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    env["SPARK_CONF_DIR"] = str(tmp_path / "conf")
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "all well" in done.stdout, done.stderr[-3000:]
