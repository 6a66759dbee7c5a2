import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_queries_and_sql_have_matching_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("gone", [("corpus_pipeline", "tidemark.llm"), ("tokenizers",), ("xxhash",)])
def test_the_rest_imports_without_the_corpus_operators(tmp_path, gone):
    for name in ("__spark_entry__.py", "tidemark", "corpus_pipeline.py"):
        (tmp_path / name).symlink_to(ROOT / name)
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        f"        if name.startswith({gone!r}):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_queries_run_in_a_copy_without_the_folders(tmp_path):
    """What the driver does: the folders are deleted, the rest is tested."""
    for source in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in source.parts:
            target = tmp_path / source.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(source.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; names = e.queries(); assert 'flagship' in names and 'pipeline' not in names and len(names) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
