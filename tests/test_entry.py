"""The driver's contract."""

import os

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "p6_found" in q
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    assert e.entry(spark).count() > 0


def test_core_stands_alone():
    import pathlib

    core = pathlib.Path(__file__).parent.parent / "loomseek"
    for p in core.rglob("*.py"):
        if "llm" not in p.relative_to(core).parts:
            assert "loomseek.llm" not in p.read_text()


def test_runs_without_the_training_text_operators():
    import pathlib
    import subprocess
    import sys

    code = "import sys; sys.modules['loomseek.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p6_found' in q and 'search_notes' in q and set(e.oracle_sql()) <= set(q) and not [k for k in q if k[:1] == 'p' and k[1:2].isdigit() and k[:2] != 'p6'], sorted(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(__file__).parent.parent, timeout=120)
