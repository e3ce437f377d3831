"""The shared folder where none is configured."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from ledgerlight.session import session
from ledgerlight.llm.common import drop_written, shared_dir, written
spark = session("local[1]", partitions=1, memory="1g")
assert not spark.conf.get("spark.checkpoint.dir", None)
df = written(spark.range(3), "x")
assert df.count() == 3 and shared_dir(spark) == shared_dir(spark)
drop_written(df)
import types
cluster = types.SimpleNamespace(conf=spark.conf, sparkContext=types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
try:
    shared_dir(cluster)
except ValueError as e:
    print("refused")
"""


def test_without_a_configured_folder(tmp_path):
    root = Path(__file__).resolve().parents[2]
    env = {k: v for k, v in os.environ.items() if k != "SPARK_CONF_DIR"} | {"SPARK_CONF_DIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", CODE], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "refused" in out.stdout, out.stderr[-2000:]
