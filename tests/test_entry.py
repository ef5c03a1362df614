"""The entry module: its three functions agree, and it imports without the training-data operators."""

from __future__ import annotations

import subprocess
import sys

from tests.conftest import ROOT

import __spark_entry__


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["song_id", "label", "frames"] and df.count() > 0


def test_imports_without_the_training_data_operators():
    code = "import sys; sys.modules['annotide.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
