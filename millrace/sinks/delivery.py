"""Delivery of rows to an outside channel: per-row send with retries, outcome rows instead of exceptions."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.lexicon import IMAGE_TROUBLE

TEXT_LIMIT, CAPTION_LIMIT = 4096, 1024
ATTEMPTS = 4
#: What a sender returns: (HTTP status, seconds the other side asks to wait or None, description).
Reply = tuple[int, float | None, str]


def retry_wait(attempt: int, asked: float | None, jitter: float) -> float:
    """Seconds before the next attempt: what was asked for and one more, else doubling from two, and up to a second."""
    return asked + 1 if asked is not None else 2 * 2**attempt + jitter


def send_with_retry(send: Callable[[dict], Reply], row: dict, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> tuple[int, int, str]:
    """(status, attempts made, description); 429, 5xx and lost connections (status 0) are tried again."""
    status, said = 0, ""
    for n in range(attempts):
        try:
            status, asked, said = send(row)
        except OSError as e:
            status, asked, said = 0, None, str(e)
        if status != 429 and 0 < status < 500:
            return status, n + 1, said
        if n + 1 < attempts:
            sleep(retry_wait(n, asked, random.random()))
    return status, attempts, said


def clipped(text: Column, limit: int = TEXT_LIMIT, marker: str = "\n… (cut)") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit - len(marker))), F.lit(marker))).otherwise(text)


def falls_back_to_text(status: Column, description: Column) -> Column:
    """Whether a failed image delivery may be repeated as text: a 400 that complains about the image, nothing else."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return (status == 400) & F.exists(F.array(*[F.lit(x) for x in IMAGE_TROUBLE]), lambda x: F.contains(low, x))


def deliver(rows: DataFrame, key: str, send: Callable[[dict], Reply], attempts: int = ATTEMPTS, parallel: int | None = None) -> DataFrame:
    """(key, status, attempts, description) of each row. A row that fails doesn't stop the others. At-least-once: a task
    that is run again sends again, so *send* should carry the key."""
    if parallel:
        rows = rows.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [(r[key], *send_with_retry(send, r, attempts)) for r in b.to_dict("records")]
            yield pd.DataFrame(done, columns=[key, "status", "attempts", "description"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, status int, attempts int, description string")


def deliver_posts(rows: DataFrame, key: str, image: str, send_image: Callable[[dict], Reply], send_text: Callable[[dict], Reply], attempts: int = ATTEMPTS, parallel: int | None = None) -> DataFrame:
    """(key, sent_as, status, attempts, description): rows with an image go out with it, all others as text; a row whose
    image was refused for the image's sake goes out as text after all. Other failures aren't repeated as text, since the post
    may have arrived."""
    if parallel:
        rows = rows.repartition(parallel)

    def one(row: dict) -> tuple:
        made = 0
        if row[image]:
            status, made, said = send_with_retry(send_image, row, attempts)
            if status != 400 or not any(w in (said or "").lower() for w in IMAGE_TROUBLE):
                return row[key], "image", status, made, said
        status, more, said = send_with_retry(send_text, row, attempts)
        return row[key], "text", status, made + more, said

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.astype(object).where(b.notna(), None)
            yield pd.DataFrame([one(r) for r in b.to_dict("records")], columns=[key, "sent_as", "status", "attempts", "description"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, sent_as string, status int, attempts int, description string")


def alert(text: str, target: str | None, send: Callable[[dict], Reply], attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether an alert was sent: without a target nothing is done, and a failure is an outcome, never an error."""
    if not (target or "").strip():
        return False
    try:
        return 200 <= send_with_retry(send, {"target": target.strip(), "text": text}, attempts, sleep)[0] < 300
    except Exception:  # an alert must not stop what it tells about
        return False


def run_writes(writes: list[tuple[str, Callable[[], None]]]) -> list[tuple[str, bool, str]]:
    """(name, ok, error) of each write; one that fails doesn't keep the others from being tried."""
    out = []
    for name, write in writes:
        try:
            write()
            out.append((name, True, ""))
        except Exception as e:  # the outcome is the error
            out.append((name, False, str(e)[:400]))
    return out


def keep_newest(rows: DataFrame, order: list[Column], path: str, most: int = 1000) -> None:
    """Rewrite a JSON history with its newest rows only."""
    rows.orderBy(*order).limit(most).coalesce(1).write.mode("overwrite").json(path)
