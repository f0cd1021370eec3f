"""The entry point without the text part, or without a library that only the text part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["ahocorasick", "public_tokenizers", "xxhash", "tokenizers", "patronage.llm", "corpus_pipeline"])
def test_other_queries_stay_without(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = set(e.queries())
assert "a1_customer_rollup" in names and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(e.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
