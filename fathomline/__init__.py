"""Spark-native analytics for heterogeneous field observations."""

import os

# tasks are the unit of parallelism: linear algebra threads would only compete with them
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")

__version__ = "0.1.0"
