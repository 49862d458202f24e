"""Links of users to devices: the same pairs, counts and objects as by expanding everything, without expanding everything."""

import random

import pytest

from roadtrace.operators import hierarchy, lookups


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    groups = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (5, None)], "id long, group_id long")
    devices = spark.createDataFrame([(i, r.choice([1, 2, 3, 4, 5, None])) for i in range(60)] + [(i, r.choice([2, 3, 5])) for i in range(20)] + [(7, 2), (None, 3)], "id long, group_id long")
    user_device = spark.createDataFrame([(r.randrange(30), r.randrange(70)) for _ in range(300)] + [(None, 3), (2, None)], "user_id long, device_id long")
    user_group = spark.createDataFrame([(r.randrange(25), r.randrange(1, 7)) for _ in range(40)] + [(None, 1)], "user_id long, group_id long")
    return user_device, user_group, groups, devices


def expanded(tables):
    user_device, user_group, groups, devices = ([tuple(r) for r in t.collect()] for t in tables)
    up = dict(groups)
    pairs = set(user_device)
    for device, group in devices:
        while group is not None:
            pairs |= {(u, device) for u, g in user_group if g == group}
            group = up.get(group)
    return pairs


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_access_equals_expansion(spark, tables, monkeypatch, most):
    monkeypatch.setattr(hierarchy, "MOST_LINKS", most)
    want, access = expanded(tables), hierarchy.access(*tables)
    by_user = lambda x: sorted(x, key=repr)
    assert access.broadcast == (most > 0)
    assert by_user(map(tuple, access.pairs().collect())) == by_user(want)
    assert {(r.device_id, r.users) for r in access.counts().collect()} == {(d, sum(x == d for _, x in want)) for d in {x for _, x in want}}
    events = spark.createDataFrame([(i % 70, i) for i in range(200)] + [(3, 0), (3, 0)], "device_id long, position_id long")
    met = [(u, d, p) for d, p in map(tuple, events.collect()) for u, x in want if x == d]
    assert by_user(map(tuple, access.users(events).select("user_id", "device_id", "position_id").collect())) == by_user(met)
    left = [x for x in met if x[0] is not None and x[0] not in (1, 2)]
    assert by_user(map(tuple, access.without([1, 2]).users(events).select("user_id", "device_id", "position_id").collect())) == by_user(left)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_not_shuffled_or_made_distinct(spark, tables):
    """Users times devices go straight to the output: the only join by place is one with broadcast links, under no aggregate."""
    text = plan(hierarchy.access(*tables).pairs())
    top = text[: text.index("Join Inner")]
    assert "Aggregate" not in top and "Repartition" not in top and "strategy=broadcast" in text.splitlines()[[i for i, x in enumerate(text.splitlines()) if "Join Inner" in x][0]]


def test_notifications_of_devices(spark, tables):
    want, access = expanded(tables), hierarchy.access(*tables)
    linked = spark.createDataFrame([(1, 9), (2, 1)], "device_id long, notification_id int")
    always = spark.createDataFrame([(1,), (3,)], "notification_id int")
    on = [(u, n) for u in range(12) for n in range(1, 5) if (u + n) % 2]
    got = lookups.device_notifications(linked, always, spark.createDataFrame(on, "user_id long, notification_id int"), access).collect()
    assert sorted(map(tuple, got), key=repr) == sorted({(1, 9), (2, 1)} | {(d, n) for u, d in want for v, n in on if u == v and n in (1, 3)}, key=repr)
