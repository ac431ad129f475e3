import re
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_nothing_outside_imports_the_llm_subpackage():
    for path in [*(REPO / "tracewright").rglob("*.py"), REPO / "bench.py"]:
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"tracewright\.llm|import corpus_pipeline", path.read_text()), path


def test_entry_works_without_the_llm_subpackage(tmp_path):
    shutil.copytree(REPO / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 30 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:" + ":".join(p for p in sys.path if "site-packages" in p)})


def test_flagship(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    assert set(__spark_entry__.entry(spark).columns) == {"rule_id", "severity", "n"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
