"""Cohort retention against a plain loop, and on the cases that the docstring defines."""

import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from loomstat.llm import retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, bin int, h1 string"
CLIENTS = "client_id long, segment string, n int"
T = datetime(2024, 1, 1)


def naive(clicks, clients, cutoffs, cohort_days=1, period_days=1):
    segment = {}
    for c, s, _ in clients:
        if s is not None:
            segment[c] = min(segment.get(c, s), s)
    day = lambda t: (t - datetime(1970, 1, 1)) // timedelta(days=cohort_days)
    rows = {r for r in clicks if r[1] is not None and r[3] is not None}
    known = [[r for r in rows if x is None or r[2] is not None and r[2] < datetime.fromisoformat(x)] for x in cutoffs]
    starts = []
    for own in known:
        s = {}
        for r in own:
            if r[4] == "signup":
                s[r[3]] = min(s.get(r[3], r[1]), r[1])
        starts.append(s)
    cells = defaultdict(lambda: [set(), 0])
    for j, own in enumerate(known):
        for r in own:
            start = starts[j].get(r[3])
            if start is not None and r[1] >= start:
                cell = cells[j, segment.get(r[3], ""), day(start), (r[1] - start) // timedelta(days=period_days)]
                cell[0].add(r[3])
                cell[1] += 0 if r[5] is None else int((100 * r[5] + 0.5) // 1)
    moved = {c for c, s in starts[0].items() if c in starts[-1] and day(s) != day(starts[-1][c])}
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), len(u & moved), cents) for k, (u, cents) in cells.items())


def rows(df):
    names = ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("days", [(1, 1), (7, 3)])
def test_hot_client_over_salts(spark, days):
    """A third of the rows has one client; the limits are low, so that it has many salts and bins hold several clients."""
    clicks = []
    for i in range(3000):
        client = 5 if i % 3 == 0 else i % 41 - 3
        ts = T + timedelta(minutes=17 * i, microseconds=i)
        late = timedelta(days=40 if i % 5 == 0 else 0)
        clicks.append((i, ts, ts + late, client, "signup" if i % 29 == 3 else "view", i / 8 - 30, "{}", 1, None))
    clicks += clicks[:50]  # equal rows count once, rows that differ in a null alone do not
    clicks += [(*r[:8], "x") for r in clicks[:20]] + [(*r[:6], None, 1, None) for r in clicks[:20]]
    clients = [(c, ["a", "b", None][c % 3], 1) for c in range(30)] + [(4, "A", 2), (None, "z", 1)]
    cutoffs = ("2024-01-12 00:00:00", None)
    got = retention.retention(
        spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), cutoffs=cutoffs, cohort_days=days[0], period_days=days[1], least_rows=20, bin_rows=100
    )
    assert rows(got) == naive(clicks, clients, cutoffs, *days)


def test_defined_cases(spark):
    at = datetime(1969, 12, 31, 23, 59, 59, 999999)
    clicks = [
        (1, at, None, 1, "signup", None, None, 0, ""),  # never arrived: state 1 alone; before 1970
        (2, T, T, 1, "view", float("nan"), None, 0, ""),
        (None, T, T, 2, "signup", 1.005, None, 0, ""),
        (3, None, T, 2, "signup", 9.0, None, 0, ""),
        (4, T, T, None, "signup", 9.0, None, 0, ""),
        (5, T - timedelta(microseconds=1), T, 2, "view", 9.0, None, 0, ""),  # before its start
        (6, T, T, 2, None, -0.5, None, 0, ""),
        (7, T, T, 3, "view", 1.0, None, 0, ""),  # never starts
    ]
    got = rows(retention.retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame([], CLIENTS), cutoffs=("2024-06-01 00:00:00", None)))
    crc = lambda c: zlib.crc32(str(c).encode())
    assert got == [(0, "", 19723, 0, 1, crc(2), 0, 50), (1, "", -1, 0, 1, crc(1), 0, 0), (1, "", -1, 19723, 1, crc(1), 0, 0), (1, "", 19723, 0, 1, crc(2), 0, 50)]
    assert rows(retention.retention(spark.createDataFrame([], CLICKS), spark.createDataFrame([(1, "a", 1)], CLIENTS))) == []
