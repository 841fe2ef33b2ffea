"""The text subpackage is optional: nothing else imports it, and the entry works without it."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_nothing_else_imports_the_text_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "loomwake")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                text = open(os.path.join(folder, f), encoding="utf-8").read()
                assert not re.search(r"loomwake\.llm|from loomwake import .*llm", text), f


def test_entry_without_it():
    code = "import sys; sys.modules['loomwake.llm'] = None; import __spark_entry__ as e; print(sorted(e.queries())); assert 'p2_found' in e.queries() and 'p1_found' not in e.queries(); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, capture_output=True)
