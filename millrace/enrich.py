"""Enrichment of rows through a chain of providers, with a circuit breaker, and an extractive stand-in that needs none."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

#: A provider takes a prompt and returns (HTTP status, text).
Provider = Callable[[str], tuple[int, str]]
DEAD_AFTER, CONTENT_CHARS = 2, 3000


def prompt(template: str, title: str | None, snippet: str | None) -> str:
    content = (snippet or "").strip() or title or ""
    return template.replace("{title}", title or "").replace("{content}", content[:CONTENT_CHARS])


def extractive(text: str) -> tuple[int, str]:
    """Stand-in provider: the first sentences of the text as bullets."""
    lines = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s.strip()]
    head = lines[0] if lines else ""
    return 200, json.dumps({"title": head[:150], "bullets": lines[:3], "whyItMatters": lines[-1] if lines else "", "enTldr": head[:200], "hashtags": []})


def provider_keys(name: str, keys: list[str]) -> list[str]:
    """Names of the instances of a provider with several keys; numbered only if there is more than one."""
    return [name] if len(keys) == 1 else [f"{name}#k{i}" for i in range(len(keys))]


def ask_chain(chain: list[tuple[str, Provider]], text: str, failures: dict[str, int], usable: Callable[[str], bool]) -> tuple[str | None, str | None]:
    """(provider, answer) of the first provider that gives a usable answer. One that failed DEAD_AFTER times in a row with
    5xx or a lost connection, or once for good (401, 403), is not asked again."""
    for name, call in chain:
        if failures.get(name, 0) >= DEAD_AFTER:
            continue
        try:
            status, answer = call(text)
        except OSError:
            status, answer = 599, ""
        if 200 <= status < 300:
            failures[name] = 0
            if usable(answer):
                return name, answer
        elif status in (401, 403):
            failures[name] = DEAD_AFTER
        elif status >= 500:
            failures[name] = failures.get(name, 0) + 1
    return None, None


def _is_object(answer: str) -> bool:
    try:
        return isinstance(json.loads(answer), dict)
    except ValueError:
        return False


def summarize(rows: DataFrame, key: str, chain: list[tuple[str, Provider]], template: str = "{content}", parallel: int = 6) -> DataFrame:
    """(key, provider, answer) of rows (key, title, snippet); *parallel* partitions, each with its own circuit breaker."""

    def run(batches: Iterator[pd.DataFrame], chain=chain) -> Iterator[pd.DataFrame]:
        failures: dict[str, int] = {}
        ask = partial(ask_chain, chain, failures=failures, usable=_is_object)
        for b in batches:
            yield pd.DataFrame([(r[key], *ask(prompt(template, r["title"], r["snippet"]))) for r in b.to_dict("records")], columns=[key, "provider", "answer"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "title", "snippet").repartition(parallel, key).mapInPandas(run, f"{key} {kind}, provider string, answer string")


def probe(chain: list[tuple[str, Provider]], text: str = "ping") -> list[tuple[str, bool, str]]:
    """(name, ok, error) of every provider, in order."""
    out = []
    for name, call in chain:
        try:
            status, answer = call(text)
            out.append((name, 200 <= status < 300, "" if 200 <= status < 300 else f"HTTP {status}: {answer}"[:400]))
        except Exception as e:  # the outcome is the error
            out.append((name, False, str(e)[:400]))
    return out
