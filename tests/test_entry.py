"""The driver's entry stands by itself: without the training-data subpackage the other queries remain."""

import subprocess
import sys

from .conftest import ROOT

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("lodestone.llm"):
            raise ModuleNotFoundError(f"no {name}", name="lodestone.llm" if name.startswith("lodestone.llm") else name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
"""


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=60)


def test_a_missing_library_is_an_error():
    gone = WITHOUT.split("import __spark_entry__")[0].replace('name == "corpus_pipeline" or name.startswith("lodestone.llm")', 'name == "xxhash"').replace('"lodestone.llm" if name.startswith("lodestone.llm") else name', "name")
    ran = subprocess.run([sys.executable, "-c", gone + "import __spark_entry__"], cwd=ROOT, capture_output=True, text=True, timeout=60)
    assert ran.returncode and "xxhash" in ran.stderr


def test_nothing_else_imports_the_subpackage():
    import pathlib

    for path in pathlib.Path(ROOT, "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert ".llm" not in path.read_text() and "lodestone import llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["template", "df"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
