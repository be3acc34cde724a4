"""The entry without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("lodestream/llm", "corpus_pipeline.py"), ("lodestream/llm",), ("corpus_pipeline.py",)])
def test_entry_works_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT / "lodestream", copy / "lodestream", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, copy / name)
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'agg15_hourly_rollup' in q; print(len(q), 'pipeline' in q, 'op1_warc' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=False, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert out.returncode == 0, out.stderr
    count, has_pipeline, has_op1 = out.stdout.split()
    assert int(count) > 200
    if "lodestream/llm" in gone:
        assert (has_pipeline, has_op1) == ("False", "False")
