"""Executors need no copy of the package: queries run from a session that is started outside the repository."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.append({repo!r})
from plumbline.session import local_session
spark = local_session(2)
from plumbline.llm.queries import QUERIES
for name in ("op4_toxicity", "op6_html_text", "op7_language_id", "op11_token_alignment", "op13_nearest_neighbours"):
    print(name, QUERIES[name](spark, {sf!r}).count())
"""


def test_operators_run_without_the_package_on_executors(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    repo = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=repo, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("op") >= 5
