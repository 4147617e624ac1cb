"""Every operator as the first query of an application of its own: what only a warm session hides shows here."""

import subprocess
import sys
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")
from tidemark.llm import queries  # noqa: E402

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
import __spark_entry__
__spark_entry__.queries()[{name!r}](spark, "/root/testdata/sf0.01").write.parquet({out!r})
print("rows", spark.read.parquet({out!r}).count())
"""


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.startswith("op")])
def test_first_query(name, tmp_path):
    got = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), name=name, out=str(tmp_path / "out"))], capture_output=True, text=True, timeout=600)
    assert got.returncode == 0, got.stderr[-3000:]
    assert int(got.stdout.split("rows ")[1]) > 0
