"""The entry module works, with and without its optional part."""

import subprocess
import sys

import __spark_entry__ as E


def test_names_and_oracles_match():
    assert set(E.oracle_sql()) <= set(E.queries()) and "detect_full_pipeline" in E.queries()


def test_without_the_optional_part():
    code = "import sys\nfor m in ('corpus_pipeline', 'veilspark.llm'):\n    sys.modules[m] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'pipeline' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=E.__file__.rpartition("/")[0])


def test_entry(spark):
    assert E.entry(spark).limit(1).count() == 1
