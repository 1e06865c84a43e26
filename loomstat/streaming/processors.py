"""Stateful processors: admission by prefix sums of time buckets, alerts that fire once at a crossing.

They need ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE_US, DAY_US = 60_000_000, 86_400_000_000
#: A bucket is longer than a minute and divides a day.
BUCKET_US = 600_000_000
BUCKETS_A_DAY = DAY_US // BUCKET_US

#: kind 0-2: what a bucket holds before a request's time, a minute and a day before it; 3: what a bucket got.
SUMS = "api_type string, bucket long, ts timestamp, kind int, id long, us long, n long, tokens long, cost long, next long, behind long"
DECISIONS = "id long, api_type string, decision string, wait_ms long"
_NAMES = [x.split()[0] for x in SUMS.split(", ")]


class BucketSums(StatefulProcessor):
    """Keyed by API and time bucket: answers how much of the bucket lies before given times, tells later buckets what it got.

    The state is a list with one entry of arrays for each batch; it goes when no request can ask for it any more.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "us array<long>, tokens array<long>, cost array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        api, bucket = key[0], int(key[1])
        asked = pd.concat(list(rows))
        own = asked[asked["kind"] == 0]
        held = list(self.rows.get())
        cols = [np.concatenate([*[np.asarray(h[i], "i8") for h in held], own[c].to_numpy("i8")]) for i, c in enumerate(("us", "tokens", "cost"))]
        if len(own):
            self.rows.appendValue(tuple(own[c].tolist() for c in ("us", "tokens", "cost")))
            self.handle.registerTimer(((bucket + 1) * BUCKET_US + DAY_US) // 1000 + 1)
        order = np.argsort(cols[0], kind="stable")
        us = cols[0][order]
        sums = [np.concatenate([[0], np.cumsum(c[order])]) for c in cols[1:]]
        x = asked["x"].to_numpy("i8")
        at = np.searchsorted(us, x)
        # kind 0: the first of the bucket; kind 1: the first from a minute before on; -1: none
        first = np.where(asked["kind"].to_numpy() == 0, 0, at)
        found = (first < len(us)) & ((asked["kind"].to_numpy() != 0) | (at > 0))
        after = np.where(found, us[np.minimum(first, max(len(us) - 1, 0))] if len(us) else -1, -1)
        yield pd.DataFrame(
            {
                "api_type": api, "bucket": asked["us"].to_numpy("i8") // BUCKET_US, "ts": asked["ts"], "kind": asked["kind"], "id": asked["id"],
                "us": asked["us"], "n": at, "tokens": sums[0][at], "cost": sums[1][at], "next": after, "behind": 0,
            }
        )[_NAMES]
        if len(own):
            behind = np.arange(1, BUCKETS_A_DAY + 1)
            got = {"n": len(own), "tokens": int(own["tokens"].sum()), "cost": int(own["cost"].sum())}
            yield pd.DataFrame({"api_type": api, "bucket": bucket + behind, "ts": own["ts"].max(), "kind": 3, "id": 0, "us": 0, **got, "next": -1, "behind": behind})[_NAMES]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        return iter(())

    def close(self) -> None:
        pass


class Decisions(StatefulProcessor):
    """Keyed by API and the bucket of requests: the totals of a day of buckets before it, and the decisions."""

    def __init__(self, limits: dict[str, dict[str, float]]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "n long, tokens long, cost long, n1 long, tokens1 long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows))
        n, tokens, cost, n1, tokens1 = self.base.get() if self.base.exists() else (0, 0, 0, 0, 0)
        got = df[df["kind"] == 3]
        if len(got):
            near = got[got["behind"] == 1]
            n, tokens, cost = (int(v + got[c].sum()) for v, c in ((n, "n"), (tokens, "tokens"), (cost, "cost")))
            n1, tokens1 = int(n1 + near["n"].sum()), int(tokens1 + near["tokens"].sum())
            self.base.update((n, tokens, cost, n1, tokens1))
            self.handle.registerTimer((int(key[1]) + 1) * BUCKET_US // 1000 + 1)
        ask = [df[df["kind"] == k].sort_values(["us", "id"]) for k in range(3)]
        if not len(ask[0]):
            return
        at, minute, day = ({c: a[c].to_numpy("i8") for c in ("us", "n", "tokens", "cost", "next")} for a in ask)
        us = at["us"]
        apart = (us - MINUTE_US) // BUCKET_US < us // BUCKET_US  # the minute begins in the bucket before
        n_minute = at["n"] - minute["n"] + np.where(apart, n1, 0)
        tokens_minute = at["tokens"] - minute["tokens"] + np.where(apart, tokens1, 0)
        n_day, tokens_day, cost_day = (at[c] - day[c] + v for c, v in (("n", n), ("tokens", tokens), ("cost", cost)))
        oldest = np.where(apart & (minute["next"] < 0), at["next"], minute["next"])
        lim = self.limits[key[0]]
        full = [cost_day >= lim["day_cost"], n_day >= lim["rpd"], tokens_day >= lim["tpd"], n_minute >= lim["rpm"], tokens_minute >= lim["tpm"]]
        said = np.select(full, ["reject_cost", "reject_requests", "reject_tokens", "delay", "delay_tokens"], "admit")
        waits = (full[3] | full[4]) & ~(full[0] | full[1] | full[2]) & (n_minute > 0)
        wait = np.where(waits, 60_000 - (us - oldest) // 1000, 0)
        yield pd.DataFrame({"id": ask[0]["id"].to_numpy("i8"), "api_type": key[0], "decision": said, "wait_ms": wait})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.base.clear()
        return iter(())

    def close(self) -> None:
        pass


ALERTS = "id long, key string, n long"


class Crossings(StatefulProcessor):
    """Keyed by what is counted: fires at rows at which the count of the last ``span_us`` first passes ``more_than``.

    The state is the times of the last span and whether the alert is on.
    """

    def __init__(self, span_us: int, more_than: int):
        self.span_us, self.more_than = span_us, more_than

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "us array<long>, above boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        df = pd.concat(list(rows)).sort_values(["us", "id"])
        old, above = self.recent.get() if self.recent.exists() else ([], False)
        own = df["us"].to_numpy("i8")
        us = np.concatenate([np.asarray(old, "i8"), own])
        late = len(us) > 1 and bool((us[1:] < us[:-1]).any())
        known = np.sort(us) if late else us
        n = (np.searchsorted(known, own, "right") if late else np.arange(len(old), len(us)) + 1) - np.searchsorted(known, own - self.span_us)
        high = n > self.more_than
        fires = high & ~np.concatenate([[bool(above)], high[:-1]])
        keep = known[known >= known[-1] - self.span_us]
        self.recent.update((keep.tolist(), bool(high[-1])))
        self.handle.registerTimer(int(known[-1] + self.span_us) // 1000 + 1)
        yield pd.DataFrame({"id": df["id"].to_numpy("i8")[fires], "key": key[0], "n": n[fires]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.recent.exists():
            us, _ = self.recent.get()
            if expiredTimerInfo.getExpiryTimeInMs() > (us[-1] + self.span_us) // 1000:
                self.recent.clear()  # the count is zero again
        return iter(())

    def close(self) -> None:
        pass
