"""The elbow query scans the operator's whole range."""

import math

from lodestone import plans
from lodestone.session import table

DIR = "/root/testdata/sf0.001"


def test_kmeans_elbow_range(spark):
    n = table(spark, DIR, "embeddings").count()
    got = sorted(r["k"] for r in plans.QUERIES["kmeans_elbow"](spark, DIR).collect())
    assert got == list(range(2, math.ceil(math.sqrt(n)) + 1)) and got[-1] > 8
