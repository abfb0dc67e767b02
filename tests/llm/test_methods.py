"""The rule of op8 by brute force over all choices."""

import numpy as np

from tessella.llm import packing


def test_each_piece_goes_where_the_sum_of_squares_becomes_smallest():
    rng = np.random.default_rng(8)
    for capacity in (16, 60):
        lengths = -np.sort(-rng.integers(1, capacity, 400))
        where, left = packing.sum_of_squares(lengths, capacity)
        gaps: list[int] = []  # of the bins, by number
        for s, b in zip(lengths.tolist(), where.tolist(), strict=True):
            def squares(changed):
                return sum(x * x for x in np.bincount([g for g in changed if 0 < g < capacity], minlength=capacity + 1))

            choices = {g: squares([x for k, x in enumerate(gaps) if k != gaps.index(g)] + [g - s]) for g in set(gaps) if g >= s}
            opened = squares([*gaps, capacity - s])
            best = min([*choices.values(), opened])
            if b == len(gaps):
                gaps.append(capacity)
                assert opened == best and best < min(choices.values(), default=best + 1)
            else:
                assert choices[gaps[b]] == best and gaps[b] == min(g for g, x in choices.items() if x == best)
            gaps[b] -= s
        assert gaps == left and min(gaps) >= 0


def test_bins_are_gapless_and_few():
    rng = np.random.default_rng(9)
    for capacity, n in ((64, 2000), (4096, 5000), (10, 300), (4, 0), (4096, 1)):
        lengths = rng.integers(1, capacity, n)
        where, offset, bins = packing.bins(lengths, capacity)
        assert sorted(set(where.tolist())) == list(range(bins))
        for b in range(bins):
            at = 0
            for o, s in sorted(zip(offset[where == b].tolist(), lengths[where == b].tolist(), strict=True)):
                assert o == at
                at += s
            assert at <= capacity
        assert bins <= 1.03 * -(-lengths.sum() // capacity) + 1


def test_rows_that_are_alike_spread_over_all_shards(spark):
    from pyspark.sql import functions as F

    parts = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"))
    per = packing.pack(parts, shard=10_000).groupBy(F.shiftright("sequence_id", 32).alias("shard")).count().collect()
    assert len(per) == 3 and max(r["count"] for r in per) < 1.2 * min(r["count"] for r in per)
