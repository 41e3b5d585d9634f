"""Queries on workers that cannot import the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from spanferry.session import build_session
from spanferry.llm.queries import QUERIES
spark = build_session("plain", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__checkpoint__dir={folder!r},
                      spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("OFF")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("spanferry") is not None])], ["found"])

assert not spark.range(1).mapInArrow(importable, "found boolean").first()[0], "the workers have the package"
for name in {names!r}:
    print(name, QUERIES[name](spark, {tables!r}).count())
"""


def test_models_travel_with_their_code(tmp_path):
    names = ["op6_nearest_neighbours", "op7_toxicity", "op11_importance_resampling", "op12_spelling_variants", "op13_suffix_dedup"]
    tables = "/root/testdata/sf0.001"
    if not os.path.isdir(tables):
        pytest.skip("needs the test tables")
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=str(Path(__file__).parents[2]), folder=str(tmp_path / "shared"), names=names, tables=tables))
    plain = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=plain, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(counts) == set(names) and int(counts["op7_toxicity"]) > 0 and int(counts["op6_nearest_neighbours"]) > 0
