"""Written tables: where they lie and how they go."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import pytest

from fathomline import runtime


def test_tables_are_written_and_discarded(spark):
    made = runtime.materialise(spark.range(10), "test-runtime")
    path = made._written_to.removeprefix("file://")
    assert spark.sparkContext.applicationId in path and made.count() == 10 and os.path.isdir(path)
    runtime.discard(made)
    assert not os.path.isdir(path)


def test_a_written_table_gives_the_driver_s_freed_memory_back(spark):
    """Freed blocks below one that is still held stay with the C library until they are given back."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()

    def held() -> int:  # MB outside the heap: its mappings lie elsewhere than the C library's
        total, native = 0, False
        with open(f"/proc/{pid}/smaps") as lines:
            for line in lines:
                if span := re.match(r"([0-9a-f]+)-[0-9a-f]+ ", line):
                    native = int(span[1], 16) > 1 << 40
                elif native and line.startswith("Anonymous:"):
                    total += int(line.split()[1])
        return total >> 10

    runtime.materialise(spark.range(10), "test-runtime")
    coders = [spark._jvm.java.util.zip.Deflater(9) for _ in range(800)]
    for coder in coders[:-1]:
        coder.end()
    before = held()
    runtime.materialise(spark.range(10), "test-runtime")
    assert held() < before - 20
    coders[-1].end()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session())


def test_entry_imports_without_the_training_operators(tmp_path):
    """With both folders and the pipeline gone, the other queries are there."""
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/fathomline", tmp_path / "fathomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op1') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
