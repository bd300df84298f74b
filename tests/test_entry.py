from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCK = """
import sys
class Without:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Without())
import __spark_entry__ as e
found = e.queries()
print(len(found), sum(n.startswith('op') and n[2].isdigit() for n in found), set(e.oracle_sql()) <= set(found))
"""


def test_sensor_queries_stand_without_the_corpus_part():
    for names in (("sensorframe.llm",), ("sentencepiece",), ("public_tokenizers",), ("corpus_pipeline",)):
        said = subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True)
        n, ops, inside = said.stdout.split()
        assert int(n) >= 175 and ops == "0" and inside == "True" and "left out" in said.stderr
