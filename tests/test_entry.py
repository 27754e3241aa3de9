"""The entry without the training-data folders, and what a query leaves behind."""

import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); print(len(q), len(o), any(k.startswith('op') for k in q), 'live_balance' in q)"


def _run(folder, **env):
    out = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120, env=os.environ | env)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()


def test_entry_without_the_folders():
    with tempfile.TemporaryDirectory(prefix="ledgerloom-entry-") as d:
        shutil.copy(f"{ROOT}/__spark_entry__.py", d)
        shutil.copytree(f"{ROOT}/ledgerloom", f"{d}/ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        n, oracles, ops, core = _run(d)
        assert (ops, core) == ("False", "True") and int(n) - int(oracles) == 1


def test_entry_without_a_library():
    """A folder that is there but cannot be imported takes nothing else with it."""
    with tempfile.TemporaryDirectory(prefix="ledgerloom-entry-") as d:
        shutil.copy(f"{ROOT}/__spark_entry__.py", d)
        shutil.copytree(f"{ROOT}/ledgerloom", f"{d}/ledgerloom", ignore=shutil.ignore_patterns("__pycache__"))
        with open(f"{d}/corpus_pipeline.py", "w") as f:
            f.write("import a_library_that_is_not_there\n")
        _, _, ops, core = _run(d)
        assert (ops, core) == ("False", "True")


def test_kept_frames_are_released_by_the_next_query(spark):
    import __spark_entry__ as E
    from ledgerloom.operators import sequence
    queries = E.queries()
    first = queries["requests_append"](spark, "/root/testdata/sf0.001")
    n = first.count()
    assert sequence._KEPT
    queries["last_update"](spark, "/root/testdata/sf0.001")
    assert not sequence._KEPT and first.count() == n
