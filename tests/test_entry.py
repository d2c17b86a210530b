"""The driver's contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_every_oracle_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_subpackage():
    code = "import sys; sys.modules['learngraph.llm'] = None; import __spark_entry__ as e; print(*e.queries()); e.oracle_sql()"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert "concept_graph_edges" in found and "pipeline" not in found and not any(name.startswith("op1_") for name in found)
