"""The entry module with and without the corpus folders."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_without_corpus_folders():
    done = run("import sys; sys.modules['rillway.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'hot_items' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)")
    assert done.returncode == 0, done.stderr


def test_entry_names():
    done = run("import __spark_entry__ as e; q = e.queries(); assert len(q) > 140 and all(callable(f) for f in q.values()); assert set(e.oracle_sql()) <= set(q)")
    assert done.returncode == 0, done.stderr


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["end_s", "item_id", "cnt", "rank"]
