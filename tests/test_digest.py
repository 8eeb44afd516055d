"""Digests of tables: order, repeats, nulls and the rows that differ."""

import random
from collections import Counter

from sitehex.operators import digest


def frame(spark, rows):
    return spark.createDataFrame(rows, "k bigint, v string")


def told(df):
    return {r.bucket: (r.row_count, r.hash_sum, r.hash_xor) for r in df.collect()}


def test_digest_knows_repeats_and_nulls_but_no_order(spark):
    rows = [(i, None if i % 7 == 0 else f"v{i % 13}") for i in range(500)]
    mixed = random.Random(2).sample(rows, len(rows))
    whole = told(digest.table_digest(frame(spark, rows), ["k"], ["v"], 16))
    assert whole == told(digest.table_digest(frame(spark, mixed).repartition(7), ["k"], ["v"], 16))
    assert sum(n for n, _, _ in whole.values()) == 500
    for other in (rows + rows[:1] * 2, [(k, v or "") for k, v in rows], rows[1:]):
        assert whole != told(digest.table_digest(frame(spark, other), ["k"], ["v"], 16))
    assert told(digest.table_digest(frame(spark, []), ["k"], ["v"])) == {}


def test_lengths_part_neighbouring_columns(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    assert df.select(digest.row_hash(["x", "y"]).alias("h")).distinct().count() == 2


def test_changed_rows_against_counters(spark):
    r = random.Random(6)
    left = [(r.randrange(300), r.choice(["a", "b", None])) for _ in range(900)]
    right = [x for x in left if x[0] % 50] + [(7, "new"), left[0], left[0], (None, "n")]
    a, b = Counter(left), Counter(right)
    expected = {(*x, a[x], b[x]) for x in a | b if a[x] != b[x]}
    got = digest.changed_rows(frame(spark, left), frame(spark, right), ["k"], ["v"], 64).collect()
    assert {tuple(x) for x in got} == expected and len(got) == len(expected)
    assert digest.changed_rows(frame(spark, left), frame(spark, left[::-1]), ["k"], ["v"]).collect() == []
    assert digest.changed_rows(frame(spark, []), frame(spark, []), ["k"], ["v"]).collect() == []
