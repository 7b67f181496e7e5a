"""The engine works without the corpus subpackage, and a cluster's settings are left alone."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_corpus_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tallyframe.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and set(e.oracle_sql()) == set(e.queries())\n"
        "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_corpus_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "tallyframe")):
        if "llm" in os.path.relpath(folder, ROOT).split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "tallyframe.llm" not in open(os.path.join(folder, name)).read(), name
