"""Where embedding, reranking and answering models are plugged in. The models themselves are not part of the engine."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructField, StructType


def embedder(make: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64):
    """A column function that embeds texts. ``make`` loads the model once for each task; nothing is truncated."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            own = texts.tolist()
            out = [v for k in range(0, len(own), batch) for v in model(own[k : k + batch])]
            if len(out) != len(own):
                raise ValueError("the model returned another number of vectors")
            yield pd.Series(out)

    return embed


def reranker(make: Callable[[], Callable[[list[str], list[str]], list[float]]], batch: int = 64) -> Callable[[Column, Column], Column]:
    """A column function (question, passage) of scores in [0, 1], for search()."""

    @F.pandas_udf(DoubleType())
    def rerank(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, passages in parts:
            q, p = questions.tolist(), passages.tolist()
            yield pd.Series([s for k in range(0, len(q), batch) for s in model(q[k : k + batch], p[k : k + batch])], dtype="float64")

    return rerank


def answered(prompts: DataFrame, make: Callable[[], Callable[[str], str | tuple[str, bool]]]) -> DataFrame:
    """Prompts (query_id, prompt) with the reply ``raw``, or ``error`` without any of the service's message.

    A client returns the reply, or the reply and whether it came to its own end; one that was cut off is an error.
    """

    def reply(ask, prompt):
        try:
            said = ask(prompt)
        except (OSError, ValueError, RuntimeError):
            return None, "Generation failed"
        text, ended = (said, True) if isinstance(said, str) else said
        return (text, None) if ended else (None, "The reply was cut off")

    def call(batches):
        ask = make()
        for pdf in batches:
            told = [reply(ask, prompt) for prompt in pdf["prompt"]]
            raw, error = (pd.Series([t[k] for t in told], index=pdf.index, dtype=object) for k in (0, 1))
            yield pdf.assign(raw=raw, error=error)

    schema = StructType([*prompts.schema.fields, StructField("raw", StringType()), StructField("error", StringType())])
    return prompts.mapInPandas(call, schema)


def posted(url: str, key: str, timeout: int = 60) -> Callable[[dict], dict]:
    """Sends JSON to a service and returns its JSON."""
    from urllib.request import Request, urlopen

    if not key.strip():
        raise RuntimeError("no key for the service; nothing was sent")

    def send(body: dict) -> dict:
        headers = {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}
        with urlopen(Request(url, json.dumps(body).encode(), headers), timeout=timeout) as reply:
            return json.load(reply)

    return send


def chat_client(url: str, key: str, model: str, system: str, max_tokens: int = 800, timeout: int = 60, send: Callable[[dict], dict] | None = None) -> Callable[[str], tuple[str, bool]]:
    """Replies of a service that speaks the common chat-completions format, and whether each came to its end."""
    send = send or posted(url, key, timeout)
    fixed = {"model": model, "temperature": 0, "max_tokens": max_tokens, "response_format": {"type": "json_object"}}

    def ask(prompt: str) -> tuple[str, bool]:
        turns = [{"role": role, "content": text} for role, text in (("system", system), ("user", prompt))]
        try:
            first = send(fixed | {"messages": turns})["choices"][0]
            return str(first["message"]["content"]), first.get("finish_reason", "stop") == "stop"
        except (OSError, ValueError, LookupError, TypeError, AttributeError):
            raise RuntimeError("the service gave no valid answer") from None

    return ask
