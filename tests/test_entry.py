"""The driver's contract, with the llm part and without it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _names(root: Path) -> tuple[set, set]:
    code = "import __spark_entry__ as e; print(sorted(e.queries()), sorted(e.oracle_sql()), sep=chr(10))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(root)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    queries, oracles = out.stdout.strip().split("\n")[-2:]
    return set(eval(queries)), set(eval(oracles))


def test_entry_without_the_llm_part(tmp_path):
    for name in ("helixlake", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    queries, oracles = _names(tmp_path)
    assert len(queries) > 50 and oracles <= queries and "pipeline" not in queries
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _names(tmp_path) == (queries, oracles)
    whole, known = _names(ROOT)
    assert queries <= whole and known <= whole
