import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from scripts.compare import compare
from talklake import plans

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_core_queries_equal_their_statements(spark):
    names = list(plans.queries())
    bad = [(n, note) for n, ok, note in compare(spark, DATA, names) if not ok]
    assert not bad


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are not here")
def test_entry_has_a_schema(spark):
    assert entry.entry(spark).columns == ["source_table", "doc_id", "gap_start_ms", "gap_end_ms"]


def test_registry_without_the_optional_package():
    code = (
        "import sys, importlib.util as u\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('talklake.llm') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert not any(k.startswith(('p1_', 'p4_')) for k in e.queries()) and 'p3_found' in e.queries()\n"
        "assert not any(m.startswith('talklake.llm') for m in sys.modules)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)
