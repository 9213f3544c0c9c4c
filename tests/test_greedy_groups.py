"""The greedy fold against a plain loop, with one key spread over many ranges."""

import random

from limnos.operators import sequences as Q


def test_greedy_groups_over_ranges(spark):
    rng = random.Random(5)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for limit, sizes in ((10, [0, 0, 1, 2, 3, 5, 9, 11, 40]), (1000, [0, 1, 2, 3])):
            rows = [("hot", k if k % 50 else k + 1, rng.choice(sizes)) for k in range(600)]  # some orders repeat
            rows += [(f"k{k % 30:02}", k, rng.choice(sizes)) for k in range(200)] + [("z", 1, 3)]
            rng.shuffle(rows)
            want, state = [], {}
            for key, order, size in sorted(rows):
                total, group = state.get(key, (0, -1))
                total, group = (total + size, group) if group >= 0 and total + size <= limit else (size, group + 1)
                state[key] = (total, group)
                want.append((key, order, size, group))
            got = Q.greedy_groups(spark.createDataFrame(rows, "k string, o int, s int"), ["k"], "o", "s", limit)
            assert got.columns == ["k", "o", "s", "group"] and sorted(map(tuple, got.collect())) == sorted(want)
            assert "collect_list" not in got._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
