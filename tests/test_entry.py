"""The driver's contract holds without the optional part, whatever makes it unusable."""

import subprocess
import sys
from pathlib import Path

import pytest

CODE = """
import sys, warnings
for m in {missing!r}:
    sys.modules[m] = None
warnings.simplefilter("ignore")
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 230 and not any(n.startswith("op1_") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


@pytest.mark.parametrize("missing", [["public_tokenizers"], ["regex"], ["xxhash"], ["larkspur.llm"], ["corpus_pipeline"]])
def test_without_optional_part(missing):
    subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=Path(__file__).parents[1], check=True, timeout=120)
