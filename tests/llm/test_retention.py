"""The retention matrix against brute force, with odd rows, large clients and other time zones."""

import datetime as dt
import math
import random
import zlib

import pytest

from duskline.llm import retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, users long"
CLIENTS = "client_id long, source string, state int"
EPOCH, WEEK = dt.datetime(1970, 1, 1), 7 * 86_400_000_000


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def brute(clicks, clients):
    segment = {}
    for c, s, _ in clients:
        if c is not None:
            segment[c] = max(segment.get(c) or "", s or "")
    by = {}
    for r in set(clicks):
        if r[1] is not None and r[3] is not None:
            by.setdefault(r[3], []).append(r)
    cells = {}
    for client, rows in by.items():
        start, known = {}, {}
        for s in (0, 1):
            known[s] = []
            for r in rows:
                h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
                if s or r[2] is not None and r[2] + dt.timedelta(days=h % 100 if h % 3 == 0 else 0) < dt.datetime(2024, 2, 1):
                    known[s].append(r)
            start[s] = min((micros(r[1]) for r in known[s] if r[4] == "error"), default=None)
        cohort = {s: start[s] // WEEK if start[s] is not None else None for s in (0, 1)}
        for s in (0, 1):
            for r in known[s]:
                if start[s] is not None and micros(r[1]) >= start[s]:
                    cell = cells.setdefault((s, segment.get(client) or "", cohort[s], (micros(r[1]) - start[s]) // WEEK), [set(), 0, set()])
                    cell[0].add(client)
                    cell[1] += math.floor(100 * r[5] + 0.5) if r[5] is not None else 0
                    if None not in cohort.values() and cohort[0] != cohort[1]:
                        cell[2].add(client)
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(m), cents) for k, (u, cents, m) in cells.items())


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randrange(110 * 86_400_000_000))
        client = 7 if i % 3 == 0 else rng.choice([None, *range(40)])
        rows.append((i, t if i % 50 else None, t + dt.timedelta(seconds=rng.randrange(9)) if i % 41 else None, client, rng.choice(["error", "view", "click", None]), rng.choice([None, 1.005, -2.5, rng.uniform(-9, 99)]), rng.choice([None, "{}", "x" * 70_000]), 1))
    base = dt.datetime(2024, 1, 4, 0, 0, 0, 5)
    edge = [(5000 + k, base + dt.timedelta(days=7 * k), base, 99, "error", 1.0, "{}", 1) for k in range(3)]
    edge += [(6000, base + dt.timedelta(days=7) - dt.timedelta(microseconds=1), base, 99, "view", 1.0, "{}", 1), (6001, base, base, 99, "view", 1.0, None, 1), (None, base, base, 98, "error", 1.0, None, 1)]
    edge += [(7000, dt.datetime(1969, 12, 31, 23, 59, 59, 999_999), base, 97, "error", 2.0, None, 1), (7001, dt.datetime(1970, 1, 8), base, 97, "view", None, None, 1)]
    rows += edge + edge + rows[:200]
    clients = [(c, rng.choice(["crm", "web", None]), 1) for c in range(30)] + [(3, "store", 1), (3, "store", 1), (None, "web", 1)]
    return rows, clients


@pytest.mark.parametrize("large, parts", [([], 4), ([7, 3], 5), ([123456], 3)])
def test_retention_is_brute_force(spark, tables, large, parts):
    clicks, clients = tables
    got = retention.retention(spark.createDataFrame(clicks, CLICKS).repartition(5), spark.createDataFrame(clients, CLIENTS), large, parts)
    assert sorted(map(tuple, got.collect())) == brute(clicks, clients)


def test_large_clients_and_empty_tables(spark, tables):
    clicks, clients = (spark.createDataFrame(x, s) for x, s in zip(tables, (CLICKS, CLIENTS), strict=True))
    assert retention.large_clients(clicks, share=5, least=100) == [7] and retention.large_clients(clicks) == []
    assert retention.retention(clicks.limit(0), clients).count() == 0
    assert {r.segment for r in retention.retention(clicks, clients.limit(0)).collect()} == {""}


def test_time_zone_of_the_session_does_not_matter(spark, tables):
    clicks, clients = (spark.createDataFrame(x, s) for x, s in zip(tables, (CLICKS, CLIENTS), strict=True))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert sorted(map(tuple, retention.retention(clicks, clients).collect())) == brute(*tables)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
