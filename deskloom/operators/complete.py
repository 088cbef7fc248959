"""The external completion operator: a client in Arrow partitions, with a cache, retries and one repair."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskloom.functions.text import extract_json, first_json_object
from deskloom.runtime import cut
from deskloom.sources.io import split_by_cache

REPAIR = "\n\nAnswer with one valid JSON object and nothing else."
#: Tries of a request that fails for the moment, and the first pause in seconds, which doubles.
TRIES, PAUSE = 5, 1.5
#: Blank answers after which a request asks with three times the tokens.
BLANKS = 2
REQUEST = ["key", "model", "system", "prompt", "max_tokens", "temperature"]


class Client(Protocol):
    """Answers one request; raising means the request failed."""

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float) -> str: ...


class Transient(Exception):
    """A failure that may pass, such as too many requests or a server's error; clients raise it to be asked again."""


class Offline:
    """Knows nothing: every request that the cache doesn't hold fails."""

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float) -> str:
        raise LookupError("offline, and not in the cache")


class Stub:
    """A deterministic answer from the prompt's hash, for tests."""

    def __init__(self, choices: list[str]):
        self.choices = choices

    def complete(self, model: str, system: str, prompt: str, max_tokens: int, temperature: float) -> str:
        n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16)
        return json.dumps({"intent": self.choices[n % len(self.choices)], "route": "auto" if n % 3 else "escalate", "confidence": (n % 100) / 100})


def persist(client: Client, request: tuple, *, tries: int = TRIES, pause: float = PAUSE, sleep=time.sleep) -> str:
    """The answer to one request: transient failures are tried again after doubling pauses, blank answers with a larger budget."""
    model, system, prompt, tokens, temperature = request
    blanks = 0
    for n in range(tries):
        try:
            answer = client.complete(model, system, prompt, tokens, temperature)
        except Transient:
            if n + 1 == tries:
                raise
            sleep(pause * 2**n)
            continue
        if answer.strip() or blanks == BLANKS:
            return answer
        blanks, tokens = blanks + 1, tokens * 3
    return ""


def complete(requests: DataFrame, client: Client, *, workers: int = 6, threads: int = 1, tries: int = TRIES, pause: float = PAUSE, progress=None) -> DataFrame:
    """``key, response, json, error`` of every request; a failed one has an error instead.

    An answer without a JSON object is asked for once more with an appended
    instruction. ``workers`` tasks run ``threads`` requests each at a time;
    ``progress``, an accumulator, counts what is done.
    """

    def ask(request: tuple) -> tuple[str | None, str | None, str | None]:
        try:
            answer = persist(client, request, tries=tries, pause=pause)
            found = first_json_object(answer)
            if found is None:
                model, system, prompt, *rest = request
                answer = persist(client, (model, system, prompt + REPAIR, *rest), tries=tries, pause=pause)
                found = first_json_object(answer)
            return answer, found, None if found is not None else "no JSON object in the answer"
        except Exception as e:  # noqa: BLE001 - any failure of a client is the row's error
            return None, None, str(e) or type(e).__name__

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                out = list(pool.map(ask, zip(*(batch.column(c).to_pylist() for c in REQUEST[1:]))))
                if progress is not None:
                    progress.add(len(out))
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.string()) for c in (zip(*out) if out else [[], [], []]))], ["key", "response", "json", "error"])

    return requests.select(*REQUEST).dropDuplicates(["key"]).repartition(workers, "key").mapInArrow(each, "key string, response string, json string, error string")


def complete_cached(requests: DataFrame, cache: DataFrame, client: Client, **options) -> tuple[DataFrame, DataFrame]:
    """``(answers, fresh)``: answers of all requests with ``hit``, and what to append to the cache.

    Each miss is asked for once, before this returns, however often either frame is used.
    """
    hits, misses = split_by_cache(requests.select(*REQUEST).dropDuplicates(["key"]), cache)
    told = hits.select("key", "response", extract_json("response").alias("json"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("hit"))
    fresh = cut(complete(misses, client, **options))
    return told.unionByName(fresh.withColumn("hit", F.lit(False))), fresh.where("error IS NULL").select("key", "response")
