"""The entry module with and without the training-data operators."""

import pathlib
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = pathlib.Path(__file__).parent.parent


def test_names_agree():
    known = __spark_entry__.queries()
    assert len(known) > 40 and set(__spark_entry__.oracle_sql()) <= set(known)


def test_without_the_optional_package(tmp_path):
    """A copy of the tree without either folder, with and without the pipeline beside it, still serves the catalogue."""
    for name in ("leafmill", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    script = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'bm25_topk' in q and 'bm25_topk' in s; assert not [n for n in (*q, *s) if n.startswith('op') and n[2].isdigit() or n == 'pipeline']; import bench; print('fine')"
    shutil.copy(ROOT / "bench.py", tmp_path / "bench.py")
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
        assert done.stdout.strip() == "fine", done.stderr[-2000:]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
