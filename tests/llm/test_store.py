from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

from starmart.llm.components import _lowest, components

ROOT = Path(__file__).resolve().parents[2]

ELSEWHERE = """
import importlib.util, sys
from pyspark.sql import SparkSession

spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
print("rows", entry.queries()["op7_quality"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_workers_find_the_package_from_any_folder(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run(
        [sys.executable, "-c", ELSEWHERE, str(ROOT / "__spark_entry__.py")],
        cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=240,
    )
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert int(ran.stdout.split("rows ")[1].split()[0]) > 0


def _plain(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_repeats(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(1000, 1400)] + [(7, 7), (8, 8), (8, 9)]
    links += [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)]
    rng.shuffle(links)
    rows = links + links[:50] + [(None, 5), (6, None)]
    got = [tuple(r) for r in components(spark.createDataFrame(rows, "a long, b long")).collect()]
    assert sorted(got) == sorted(_plain(links).items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_component_is_split(spark, settings):
    """A node that a third of all links end in: its rows are joined by several tasks."""
    settings(
        spark__sql__adaptive__advisoryPartitionSizeInBytes="8k",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="8k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__autoBroadcastJoinThreshold="-1",
    )
    links = [(1, k) for k in range(10_000, 50_000)] + [(k, k + 1) for k in range(100_000, 180_000, 2)]
    df = spark.createDataFrame(links, "a long, b long").repartition(16)
    sizes = defaultdict(int)
    # All columns are asked for: pruned to the hot key alone, the rows would compress to next to nothing.
    for a, _, low, part in _lowest(df, "a", "b").selectExpr("a", "b", "low", "spark_partition_id()").collect():
        if a == 1:
            assert low == 10_000
            sizes[part] += 1
    assert sum(sizes.values()) == 40_000
    assert len(sizes) > 1
