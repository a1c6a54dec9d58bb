"""The library and its entry must do without the llm subpackage."""

import re
from pathlib import Path

import sightline

ROOT = Path(sightline.__file__).parent


def test_nothing_imports_llm():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s+\S*\bllm\b", path.read_text(), re.M), path


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}
