"""New matches: repeats and stored pairs leave, and no hash table holds the pairs of a task to drop repeats."""

import random

from bazaarlens.operators import matching


def test_each_pair_once(spark):
    r = random.Random(5)
    rows = [(r.choice([None, 1, 2, 3]), r.choice([None, 1, 2, 3, 4])) for _ in range(60)]
    stored = [(1, 1), (2, 3), (None, 2), (9, 9), (1, 1)]
    matches = spark.createDataFrame([(*p, i / 100) for i, p in enumerate(rows)], "wishlist_id long, listing_id long, score double")
    new = matching.new_matches_only(matches, spark.createDataFrame(stored, "wishlist_id long, listing_id long"))
    got = [tuple(x) for x in new.collect()]
    gone = {p for p in stored if None not in p}
    assert sorted(map(repr, (p[:2] for p in got))) == sorted(map(repr, set(rows) - gone))
    assert all(rows[round(s * 100)] == (w, i) for w, i, s in got) and new.columns == ["wishlist_id", "listing_id", "score"]
    assert "HashAggregate" not in new._jdf.queryExecution().executedPlan().toString()
