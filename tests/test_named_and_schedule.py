from datetime import datetime

import pytest

from tidemark.functions.schedule import next_moment
from tidemark.operators import named


@pytest.mark.parametrize(("rule", "after", "want"), [
    ("*/15 * * * *", datetime(2024, 1, 1, 0, 14, 30), datetime(2024, 1, 1, 0, 15)),
    ("0 3 * * *", datetime(2024, 1, 1, 3, 0), datetime(2024, 1, 2, 3, 0)),
    ("30 6 29 2 *", datetime(2024, 3, 1), datetime(2028, 2, 29, 6, 30)),
    ("0 0 * * 0", datetime(2024, 1, 1), datetime(2024, 1, 7)),
    ("0 0 13 * 5", datetime(2024, 1, 6), datetime(2024, 1, 12)),
])
def test_next_moment(rule, after, want):
    assert next_moment(rule, after) == want


@pytest.mark.parametrize("rule", ["* * * *", "61 * * * *", "0 0 31 2 *", "*/0 * * * *"])
def test_bad_rules(rule):
    with pytest.raises(ValueError):
        next_moment(rule, datetime(2024, 1, 1))


def test_versions_grow_prune_and_scope(spark):
    t = spark.createDataFrame([("a/x", 1, "p1"), ("a/x", 2, "p2"), ("b", 0, "cell")], "name string, seq long, payload string")
    new = spark.createDataFrame([("a/x", "p3"), ("c", "q")], "name string, payload string")
    assert sorted(map(tuple, named.put(t, new, 2).collect())) == [("a/x", 2, "p2"), ("a/x", 3, "p3"), ("b", 0, "cell"), ("c", 1, "q")]
    assert sorted(map(tuple, named.put(t, spark.createDataFrame([("b", "z")], "name string, payload string"), 0).where("name = 'b'").collect())) == [("b", 0, "z")]
    assert [tuple(r) for r in named.scoped(named.get(t), "a").collect()] == [("x", 2, "p2")]
    assert named.delete(t, "b").count() == 2
