"""The registry, also without the optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    import __spark_entry__ as entry

    found = entry.queries()
    assert {"top_words", "corpus_stats", "restore_text", "web_audit"} <= set(found) and set(entry.oracle_sql()) <= set(found)


def test_library_does_without_the_optional_part(tmp_path):
    """A copy without the training-data operators imports, and nothing in the library names them."""
    for path in ROOT.glob("corpuslens/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(path.read_text(encoding="utf-8"), encoding="utf-8")
            assert "corpuslens.llm" not in path.read_text(encoding="utf-8")
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text(encoding="utf-8"), encoding="utf-8")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert run.returncode == 0 and run.stdout.split()[1] == "False" and int(run.stdout.split()[0]) > 60, run.stderr
