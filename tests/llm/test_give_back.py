"""Workers hand freed memory back between tasks."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import numpy as np, psutil
import pyarrow
from tidemark.llm.common import tidied
def run(batches):
    for n in batches:
        kept = [np.ones(2000) for _ in range(n)]
        pins.append(kept[-1])
        yield len(kept)
pins = []
size = lambda: psutil.Process().memory_info().rss / 1e6
PLAIN = %s
before = size()
assert list((run if PLAIN else tidied(run))([12000])) == [12000]
print(size() - before)
"""


def test_a_task_gives_its_memory_back():
    """200 MB of small arrays, the last of which stays: without the hand-back the worker would keep them."""
    grown = [float(subprocess.run([sys.executable, "-c", CODE % plain], cwd=ROOT, capture_output=True, text=True, check=True).stdout) for plain in (True, False)]
    assert grown[0] > 150 > 40 > grown[1]
