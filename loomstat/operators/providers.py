"""Model providers: a cascade called in Arrow batches, partition by partition; failures are rows with a status, never a crash.

A provider is a function of a prompt that returns a text, raises ``TimeoutError`` or another error.  A call that takes
longer than its limit counts as timed out, and its thread is left behind.  :func:`offline` stands in for all of them where no endpoint is configured.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from threading import Thread

import pyarrow as pa
from pyspark.sql import DataFrame

Provider = Callable[[str], str]
LEAST_CHARS = 10


def offline(prompt: str) -> str:
    """A deterministic stand-in that answers in the form that the parsers know."""
    topic = json.loads(prompt).get("input", "").removeprefix("Topic: ")
    return f"QUESTION: What is central to {topic}?\nA) First law\nB) Second law\nC) Third law\nD) Zeroth law\nANSWER: B"


def limited(provider: Provider, prompt: str, seconds: float | None) -> str:
    """The provider's answer, or :class:`TimeoutError` after so many seconds, whatever the provider does."""
    if seconds is None:
        return provider(prompt)
    box: list = []

    def own() -> None:
        try:
            box.append((provider(prompt), None))
        except BaseException as e:  # goes on in the caller
            box.append((None, e))

    thread = Thread(target=own, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError
    text, error = box[0]
    if error is not None:
        raise error
    return text


def call(providers: list[tuple[str, Provider]], prompt: str | None, retries: int = 3, seconds: float | None = None) -> tuple[str | None, str, str | None, int]:
    """Text, status (ok, timeout, error), provider and attempts of the first provider that answers; auth errors are not tried again."""
    status, attempts = "error", 0
    for name, provider in providers if prompt is not None else []:
        for _ in range(retries):
            attempts += 1
            try:
                text = limited(provider, prompt, seconds)
            except TimeoutError:
                status = "timeout"
                continue
            except Exception as e:  # a provider may fail in any way; its row says so
                status = "error"
                if "unauthorized" in str(e).lower() or "invalid api key" in str(e).lower():
                    break
                continue
            if text and len(text.strip()) >= LEAST_CHARS:
                return text, "ok", name, attempts
    return None, status, None, attempts


def generate(
    requests: DataFrame,
    providers: list[tuple[str, Provider]],
    *,
    partitions: int | None = None,
    concurrency: int = 3,
    retries: int = 3,
    seconds: float | None = 120,
    keep_failures: bool = True,
) -> DataFrame:
    """``id``, ``response``, ``status``, ``provider`` and ``attempts`` of each request (``id``, ``prompt``).

    Rows are dealt evenly over ``partitions`` (None: as many as there are cores), whatever their ids; each of them has
    ``concurrency`` calls open at a time, of ``seconds`` at most.  Null prompts fail; without ``keep_failures`` failed rows go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                answers = pool.map(lambda p: call(providers, p, retries, seconds), batch.column(1).to_pylist())
                rows = [(i, *a) for i, a in zip(batch.column(0).to_pylist(), answers, strict=True) if keep_failures or a[1] == "ok"]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = ("int64", "string", "string", "string", "int32")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "response", "status", "provider", "attempts"])

    parts = partitions or requests.sparkSession.sparkContext.defaultParallelism
    return requests.select("id", "prompt").repartition(parts).mapInArrow(run, "id long, response string, status string, provider string, attempts int")
