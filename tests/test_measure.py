import random
import statistics

import pytest

from recordloom.operators import measure


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
def test_quantiles(spark, share):
    r = random.Random(int(share * 100))
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(5), *(r.random() * 9 for _ in range(9))])) for _ in range(300)] + [("one", 7.0), ("none", None)]
    rows = [(g, None if v is None else float(v)) for g, v in rows]
    out = {x.g: x.q for x in measure.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", share, "q").collect()}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        at = share * (len(own) - 1)
        low = int(at)
        assert abs(out[g] - (own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low))) < 1e-9
        assert share != 0.5 or abs(out[g] - statistics.median(own)) < 1e-9
    assert "none" not in out
