"""What fitting the votes takes of the driver's memory."""

import subprocess
import sys

FITTED = """
import resource
import numpy as np, pyarrow as pa
from pyspark.sql import types as T
from tabulon.llm import quality

rng = np.random.default_rng(3)
n = quality.VoteParams().sample
w = pa.array([x.tobytes() for x in (rng.random((n, quality.TERMS)) * (rng.random((n, quality.TERMS)) < 0.2)).astype(np.float16)], pa.binary())
table = pa.table({"__id": rng.permutation(n), "label": (rng.random(n) < 0.5).astype(float), "w": w})
del w

class Sample:
    schema = T.StructType([T.StructField("__id", T.LongType())])
    mapInArrow = lambda self, *_: self
    toArrow = lambda self: table

quality.give_back() if hasattr(quality, "give_back") else None
open("/proc/self/clear_refs", "w").write("5")  # the peak so far is forgotten
high = lambda key: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith(key)) // 1024
before = high("VmRSS")
model = quality.fit(Sample())
assert model.vectors.shape == (n, 48) and abs(np.linalg.norm(model.vectors, axis=1) - 1).max() < 1e-3
print(high("VmHWM") - before)
"""


def test_fit_stays_below_160_mb():
    """It took 250 MB: all weights three times over, and every axis of the space with its work space."""
    assert int(subprocess.run([sys.executable, "-c", FITTED], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path), "OMP_NUM_THREADS": "1"}).stdout) < 160
