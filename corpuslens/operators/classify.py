"""Boolean classification of messages by an HTTP chat endpoint.

The transport is injected, so tests and offline runs use a stub. Each task
keeps one client; failures are kept per row and never stop the other rows.
"""

from __future__ import annotations

import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

from corpuslens import fixed_values as fv

# Sends one request body to one address with headers and a timeout (seconds);
# gives the decoded reply.
Transport = Callable[[str, dict, dict, float], dict]

# Requests a task sends where the caller sets no number of tasks.
TASK_REQUESTS = 200


@dataclass(frozen=True)
class Endpoint:
    base_url: str = fv.DEFAULT_ENDPOINT
    model: str = fv.DEFAULT_MODEL
    api_key: str = ""
    timeout_seconds: float = 120.0

    @classmethod
    def from_environment(cls, model: str | None = None) -> Endpoint:
        """Settings from the environment; ``model`` pins the model."""
        env = os.environ
        found = cls(
            base_url=env.get("LLM_BASE_URL", fv.DEFAULT_ENDPOINT),
            model=env.get("LLM_MODEL", fv.DEFAULT_MODEL),
            api_key=env.get("LLM_API_KEY") or env.get("OPENAI_API_KEY", ""),
            timeout_seconds=float(env.get("LLM_TIMEOUT_SECONDS", "120")),
        )
        return replace(found, model=model) if model else found

    def check(self, expected_model: str | None = None, batch: bool = False) -> Endpoint:
        if not self.base_url.strip():
            raise ValueError("a base URL is required")
        if not self.model.strip():
            raise ValueError("a model is required")
        if expected_model and self.model != expected_model:
            raise ValueError(f"this run requires {expected_model}; configured is {self.model}")
        if batch and self.base_url.rstrip("/") == fv.DEFAULT_ENDPOINT and not self.api_key:
            raise ValueError("an API key is required for the default endpoint")
        return self


def post_json(address: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(address, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


def request_body(model: str, message: str) -> dict:
    return {
        "model": model,
        "messages": [{"role": "user", "content": message}],
        **fv.REQUEST_OPTIONS,
        "response_format": fv.RESPONSE_FORMAT,
    }


def reply_text(reply: dict) -> str:
    """Text of the first choice; refusals and odd shapes are errors."""
    try:
        message = reply["choices"][0]["message"]
        refusal, content = message.get("refusal"), message.get("content")
    except (KeyError, IndexError, TypeError, AttributeError):
        raise RuntimeError("unexpected reply shape") from None
    if refusal:
        raise RuntimeError(f"the model refused: {refusal}")
    if not isinstance(content, str):
        raise RuntimeError("the reply has no text")
    return content


def ask(endpoint: Endpoint, message: str, transport: Transport = post_json) -> str:
    headers = {"Content-Type": "application/json"}
    if endpoint.api_key:
        headers["Authorization"] = f"Bearer {endpoint.api_key}"
    address = endpoint.base_url.rstrip("/") + "/chat/completions"
    return reply_text(transport(address, request_body(endpoint.model, message), headers, endpoint.timeout_seconds))


def strict_boolean(text: str) -> bool:
    """The Boolean of a reply; a name given twice counts as two fields.

    ``messages.parse_response`` is the same rule for columns of stored replies.
    """
    try:
        fields = json.loads(text, object_pairs_hook=_Fields)
    except ValueError:
        raise ValueError("the reply is not valid JSON") from None
    if not isinstance(fields, _Fields) or [name for name, _ in fields] != ["value"] or not isinstance(fields[0][1], bool):
        raise ValueError("the reply must be an object with one Boolean 'value'")
    return fields[0][1]


class _Fields(list):
    """(name, value) pairs of a JSON object, repeated names included."""


def ask_with_retry(
    endpoint: Endpoint, message: str, transport: Transport, attempts: int, sleep: Callable[[float], None]
) -> tuple[bool | None, str | None]:
    """(answer, None), or (None, reason) after the last attempt; no request without a message."""
    if message is None:
        return None, "ValueError: the question is blank"
    for attempt in range(attempts):
        if attempt:
            sleep(2 ** (attempt - 1))
        try:
            return strict_boolean(ask(endpoint, message, transport)), None
        except Exception as problem:
            reason = f"{type(problem).__name__}: {problem}"
    return None, reason


def classify(
    rows: DataFrame,
    endpoint: Endpoint,
    *,
    transport: Transport = post_json,
    attempts: int = 3,
    threads: int = 8,
    tasks: int | None = None,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Adds answer (Boolean) and error, one of them, to rows with a ``message``.

    ``tasks`` spreads the requests over that many tasks, ``threads`` overlaps
    the waiting inside one; together they bound the concurrent requests. Without
    ``tasks`` there is one for each ``TASK_REQUESTS`` rows, which are counted.
    """
    if attempts < 1 or threads < 1:
        raise ValueError("attempts and threads must be at least 1")
    endpoint.check()
    keep = [c for c in rows.columns if c != "message"]
    schema = rows.select(*keep).schema.add("answer", "boolean").add("error", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                done = list(pool.map(
                    lambda m: ask_with_retry(endpoint, m, transport, attempts, sleep), batch["message"]
                ))
                yield batch[keep].assign(answer=[d[0] for d in done], error=[d[1] for d in done])

    tasks = tasks or max(1, -(-rows.count() // TASK_REQUESTS))
    return rows.repartition(tasks).mapInPandas(run, schema)
