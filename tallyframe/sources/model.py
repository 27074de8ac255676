"""Model calls at the edge of the engine: the caller is injected, answers are tables.

Paid calls must not be repeated by task retries or by a second use of the plan, so
``asked_once`` writes the answers before anything reads them.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.attempts import TRANSIENT_CATEGORIES

ATTEMPT = "request_id bigint, ladder_index int, requested_model string, attempt_type string, raw string, rejection string, http_status int, latency_ms double"
_REPAIR = "\n\nThe answer below is not valid JSON. Return the same content as one valid JSON object and nothing else.\n\n"


class CallError(Exception):
    """A request that failed: its category and, where there was one, the status."""

    def __init__(self, category: str, http_status: int | None = None):
        super().__init__(category)
        self.category, self.http_status = category, http_status


def with_retry(call: Callable[[], dict], attempts: int = 3, first_wait: float = 1.0, longest_wait: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; transient errors are tried again after 1, 2, 4 ... seconds."""
    wait = first_wait
    for n in range(1, attempts + 1):
        try:
            return call()
        except CallError as error:
            if error.category not in TRANSIENT_CATEGORIES or n == attempts:
                raise
            sleep(min(wait, longest_wait))
            wait *= 2
    raise AssertionError("unreachable")


def _content(envelope: dict) -> tuple[str, str | None]:
    """(text, rejection) of a raw envelope, as far as the ladder must know it."""
    choices = envelope.get("choices")
    if not isinstance(choices, list) or not choices or not isinstance(choices[0], dict):
        return "", "error"
    text = (choices[0].get("message") or {}).get("content") or ""
    if choices[0].get("finish_reason") == "length":
        return text, "truncated"
    return text, None if text.strip() else "empty"


def _is_object(text: str) -> bool:
    """Whether a JSON object can be read from the text, its fence or its outermost braces."""
    bare = text.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    for candidate in (bare, text[text.find("{") : text.rfind("}") + 1]):
        try:
            if isinstance(json.loads(candidate), dict):
                return True
        except ValueError:
            continue
    return False


def ask_models(
    requests: DataFrame, caller: Callable[[str, str], dict], models: list[str], retries: int = 3, sleep: Callable[[float], None] = time.sleep
) -> DataFrame:
    """One row a request made for each (request_id, prompt): models in order until one gives a JSON object.

    A complete answer that is not JSON gets one repair by the same model; cut-off and empty answers
    and failed calls go to the next model. ``caller`` returns the raw envelope as a dict.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []

            def send(request: int, index: int, kind: str, prompt: str) -> tuple[str, str | None]:
                began = time.perf_counter()
                try:
                    envelope = with_retry(lambda: caller(models[index], prompt), retries, sleep=sleep)
                except CallError as error:
                    rows.append((request, index, models[index], kind, None, error.category, error.http_status, None))
                    return "", error.category
                text, problem = _content(envelope)
                if problem is None and not _is_object(text):
                    problem = "malformed_json"
                rows.append((request, index, models[index], kind, json.dumps(envelope), problem, None, (time.perf_counter() - began) * 1000))
                return text, problem

            for request, prompt in zip(batch["request_id"], batch["prompt"]):
                for index in range(len(models)):
                    text, problem = send(request, index, "primary" if index == 0 else "escalation", prompt)
                    if problem == "malformed_json":
                        text, problem = send(request, index, "repair", prompt + _REPAIR + text)
                    if problem is None:
                        break
            columns = ["request_id", "ladder_index", "requested_model", "attempt_type", "raw", "rejection", "http_status", "latency_ms"]
            yield pd.DataFrame(rows, columns=columns).astype({"http_status": "Int32"})

    return requests.select("request_id", "prompt").mapInPandas(ask, ATTEMPT)


def asked_once(requests: DataFrame, path: str, caller: Callable[[str, str], dict], models: list[str], **options) -> DataFrame:
    """The attempts, written to ``path`` before they are read; requests already answered there are not sent again."""
    spark = requests.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        done = spark.read.schema(ATTEMPT).parquet(path).select("request_id").distinct()
        requests = requests.join(done, "request_id", "left_anti")
    ask_models(requests, caller, models, **options).write.mode("append").parquet(path)
    return spark.read.schema(ATTEMPT).parquet(path)


def served(attempts: DataFrame) -> DataFrame:
    """The accepted attempt of each request."""
    return attempts.where(F.col("rejection").isNull()).groupBy("request_id").agg(F.min_by(F.struct("requested_model", "attempt_type", "raw"), F.col("ladder_index")).alias("a")).select("request_id", "a.*")
