"""Models as injected functions: embedders, rerankers, OCR, captions, speech; one load a worker."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Any
from urllib.request import Request, build_opener

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweaver.sources.rest import _NoRedirect, check_url

_LOADED: dict[str, tuple[str, Any]] = {}


def loaded(name: str, load: Callable[[], Any], token: str = "") -> Any:
    """A model by its name, loaded once in this worker process; another token of the name takes its place. The worker's end frees it."""
    if name not in _LOADED or _LOADED[name][0] != token:
        _LOADED[name] = (token, load())
    return _LOADED[name][1]


def release(name: str) -> bool:
    """Forget a model; whether there was one."""
    return _LOADED.pop(name, None) is not None


def applied(name: str, load: Callable[[], Callable[[list], list]], value: Column, kind: str, batch: int = 64) -> Column:
    """A model's results for a column, ``batch`` values a call; nulls stay null and are not sent."""
    token = uuid.uuid4().hex  # of this column's model: tasks share it, other columns don't

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(name, load, token)
        for s in batches:
            out: list = [None] * len(s)
            todo = [i for i, v in enumerate(s) if v is not None]
            for at in range(0, len(todo), batch):
                part = todo[at : at + batch]
                got = model([s.iloc[i] for i in part])
                if len(got) != len(part):
                    raise ValueError(f"{name} gave {len(got)} results for {len(part)} values")
                for i, v in zip(part, got, strict=True):
                    out[i] = v
            yield pd.Series(out, dtype=object, index=s.index)

    return run(value)


def described(images: DataFrame, load: Callable[[], Callable[[list], list]], name: str = "image text", given: str = "given_text", content: str = "content") -> DataFrame:
    """``images`` with text and method: text that came with an image counts before the model's."""
    made = applied(name, load, F.when(F.coalesce(F.col(given), F.lit("")) == "", F.col(content)), "string", 8)
    return images.withColumn("text", F.coalesce(F.nullif(F.col(given), F.lit("")), made)).withColumn("method", F.when(F.coalesce(F.col(given), F.lit("")) != "", "given").when(F.col("text").isNotNull(), "model").otherwise("none"))


def transcribed(audio: DataFrame, load: Callable[[], Callable[[list], list]], name: str = "speech", content: str = "content") -> DataFrame:
    """A row a segment (start, end, text) of each recording, by a model that gives lists of such triples."""
    segments = applied(name, load, F.col(content), "array<struct<start:double,end:double,text:string>>", 1)
    rest = [c for c in audio.columns if c != content]
    return audio.select(*rest, F.posexplode(segments).alias("segment", "s")).select(*rest, "segment", "s.start", "s.end", "s.text")


def hosted_embedder(url: str, key: str, model: str, post: Callable[[str, dict, dict], dict] | None = None) -> Callable[[list[str]], list[list[float]]]:
    """An embedder behind an HTTP service that takes {model, input} and gives {data: [{index, embedding}]}."""
    check_url(url)

    def send(to: str, headers: dict, body: dict) -> dict:
        request = Request(to, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})
        with build_opener(_NoRedirect).open(request, timeout=30) as r:
            return json.load(r)

    def embed(texts: list[str]) -> list[list[float]]:
        found = (post or send)(url, {"Authorization": "Bearer " + key}, {"model": model, "input": texts})["data"]
        return [x["embedding"] for x in sorted(found, key=lambda x: x["index"])]

    return embed


def embedder(provider: str, dims: int, load: Callable[[], Callable[[list], list]] | None = None, batch: int | None = None) -> Callable[[Column], Column]:
    """A column function of a provider: ``hashing`` needs no model, ``local`` and ``hosted`` are loaded by ``load``."""
    if dims <= 0:
        raise ValueError("an embedding has one dimension or more")
    if provider == "hashing":
        from orbweaver.client import hashed_embedding

        return lambda text: hashed_embedding(text, dims)
    if provider not in ("local", "hosted"):
        raise ValueError(f"the provider is hashing, local or hosted, not {provider}")
    if load is None:
        raise ValueError(f"the provider {provider} needs a model")
    size = batch or (64 if provider == "local" else 256)

    def column(text: Column) -> Column:
        v = applied(f"embedder {provider}", load, text, "array<double>", size)
        return F.when(v.isNull() | (F.size(v) == dims), v).otherwise(F.raise_error(F.lit(f"an embedding has not {dims} dimensions")))

    return column


def reranked(pairs: DataFrame, load: Callable[[], Callable[[list], list]], query: str = "query", text: str = "text", batch: int = 32) -> DataFrame:
    """``pairs`` with rerank_score: the logistic of a cross-encoder's value for question and text."""
    both = F.when(F.col(query).isNotNull() & F.col(text).isNotNull(), F.to_json(F.array(query, text)))

    def of_pairs() -> Callable[[list], list]:
        model = load()
        return lambda rows: [float(x) for x in model([tuple(json.loads(r)) for r in rows])]

    return pairs.withColumn("rerank_score", 1 / (1 + F.exp(-applied("reranker", of_pairs, both, "double", batch))))
