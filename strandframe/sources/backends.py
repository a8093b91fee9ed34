"""Scores and texts of a model as a table function with a result cache."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.text import extract_json, fill_template, first_filled, parse_rating, truthy
from strandframe.operators.joins import cache_key
from strandframe.session import cut_lineage


class ScoringBackend(ABC):
    """A model that answers requests in batches.  ``open`` runs once per task."""

    @abstractmethod
    def open(self) -> None:
        """Connect or load."""

    @abstractmethod
    def score(self, requests: pd.DataFrame) -> list[dict[str, float]]:
        """Log-probability of each option for each request."""


class CallbackBackend(ScoringBackend):
    """A backend of a plain function, for tests."""

    def __init__(self, answer: Callable[[dict], dict[str, float]]):
        self.answer = answer

    def open(self) -> None:
        pass

    def score(self, requests: pd.DataFrame) -> list[dict[str, float]]:
        return [self.answer(row) for row in requests.to_dict("records")]


def score_requests(requests: DataFrame, columns: list[str], backend: ScoringBackend, cache: DataFrame | None = None, retries: int = 1) -> DataFrame:
    """(columns, key, logprobs, cached): each distinct request is answered once;
    what the cache (key, logprobs) has is not asked again.  A failing batch is
    tried ``retries`` times more."""
    asked = cache_key(requests.select(*columns).distinct(), columns, "key")
    missing = asked if cache is None else asked.join(cache.select("key"), "key", "left_anti")
    fields = ", ".join(f"`{c}` {t}" for c, t in missing.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for batch in batches:
            for attempt in range(retries + 1):
                try:
                    answers = backend.score(batch[columns])
                    break
                except Exception:
                    if attempt == retries:
                        raise
            yield batch.assign(logprobs=answers)

    fresh = missing.mapInPandas(run, f"{fields}, logprobs map<string,double>").withColumn("cached", F.lit(False))
    if cache is None:
        return fresh.select(*columns, "key", "logprobs", "cached")
    known = asked.join(cache.select("key", "logprobs"), "key").withColumn("cached", F.lit(True))
    return fresh.select(*columns, "key", "logprobs", "cached").unionByName(known.select(*columns, "key", "logprobs", "cached"))


class TextBackend(ABC):
    """A model that writes texts.  ``open`` runs once per task."""

    name: str = "text"

    @abstractmethod
    def open(self) -> None:
        """Connect or load."""

    @abstractmethod
    def generate(self, prompts: list[str], attempt: int) -> list[str]:
        """A text for each prompt; ``attempt`` is 0 first and counts retries."""


class CallbackTexts(TextBackend):
    """A text backend of a plain function of (prompt, attempt), for tests."""

    def __init__(self, answer: Callable[[str, int], str], name: str = "callback"):
        self.answer, self.name = answer, name

    def open(self) -> None:
        pass

    def generate(self, prompts: list[str], attempt: int) -> list[str]:
        return [self.answer(p, attempt) for p in prompts]


def _generated(requests: DataFrame, backend: TextBackend, attempt: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend.open()
        for batch in batches:
            yield batch.assign(text=backend.generate(batch["prompt"].tolist(), attempt))

    return requests.mapInPandas(run, "prompt string, text string")


def generate_json(requests: DataFrame, backend: TextBackend, retries: int = 1) -> DataFrame:
    """(prompt, json): a JSON object from the model's text for each distinct prompt;
    where a text holds none the prompt is asked again, ``retries`` times at most,
    and null stays in the end.  Null prompts are not asked."""
    left, out = requests.select("prompt").where("prompt is not null").distinct(), None
    for attempt in range(retries + 1):
        told = cut_lineage(_generated(left, backend, attempt).select("prompt", extract_json(F.col("text")).alias("json")))
        last = attempt == retries
        done = told if last else told.where("json is not null")
        out = done if out is None else out.unionByName(done)
        left = told.where("json is null").select("prompt")
    return out


#: What a description says where the model leaves something out.
NO_DESCRIPTION, NO_ENTITY, NO_KIND = "A visual or physics anomaly affecting an object in the scene.", "entity", "other"


def described(json: Column, optional: bool = False) -> Column:
    """struct<description, entity, glitch_type> of a described window, with defaults
    for what is missing.  ``optional``: null unless the answer says there is a
    glitch and describes it."""
    text = F.nullif(F.trim(F.get_json_object(json, "$.description")), F.lit(""))
    entity = first_filled(F.get_json_object(json, "$.entity"), F.lit(NO_ENTITY))
    kind = first_filled(F.get_json_object(json, "$.glitch_type"), F.lit(NO_KIND))
    told = F.struct(F.coalesce(text, F.lit(NO_DESCRIPTION)).alias("description"), entity.alias("entity"), kind.alias("glitch_type"))
    return F.when(truthy(F.get_json_object(json, "$.glitch")) & text.isNotNull(), told) if optional else told


def rate_pairs(pairs: DataFrame, backend: TextBackend, template: str, config: dict, cache: DataFrame | None = None) -> DataFrame:
    """(gt, pred, key, rating, failed, cached): a judge's rating of each distinct
    pair of a true and a predicted description.

    The prompt is ``template`` with {gt} and {pred}; the key covers the backend, the
    configuration (model, temperature), the template and both texts, and a pair
    whose key the ``cache`` (key, rating, failed) has is not asked again.
    """
    asked = pairs.select("gt", "pred").where("gt is not null and pred is not null").distinct()
    fixed = [F.lit(backend.name).alias("_backend"), F.lit(repr(sorted(config.items()))).alias("_config"), F.sha1(F.lit(template)).alias("_template")]
    keyed = cache_key(asked.select("gt", "pred", *fixed), ["gt", "pred", "_backend", "_config", "_template"], "key").select("gt", "pred", "key")
    missing = keyed if cache is None else keyed.join(cache.select("key"), "key", "left_anti")
    prompts = missing.withColumn("prompt", fill_template(template, gt=F.col("gt"), pred=F.col("pred")))
    rated = _generated(prompts.select("prompt").distinct(), backend, 0).select("prompt", parse_rating(F.col("text")).alias("r"))
    fresh = prompts.join(rated, "prompt").select("gt", "pred", "key", "r.rating", "r.failed", F.lit(False).alias("cached"))
    if cache is None:
        return fresh
    known = keyed.join(cache.select("key", "rating", "failed"), "key").select("gt", "pred", "key", "rating", "failed", F.lit(True).alias("cached"))
    return fresh.unionByName(known)


@dataclass(frozen=True)
class GenerationSettings:
    """Every knob of sampling, stated."""

    temperature: float = 0.0
    top_p: float = 1.0
    top_k: int = 0
    repetition_penalty: float = 1.0

    def options(self, most_tokens: int) -> dict[str, float | int | bool]:
        """Options of a call; without a temperature it is greedy and the sampling
        knobs are neutral."""
        sampled = self.temperature > 0
        neutral = {"temperature": 1.0, "top_p": 1.0, "top_k": 0}
        chosen = {"temperature": float(self.temperature), "top_p": float(self.top_p), "top_k": max(0, int(self.top_k or 0))}
        return {"max_new_tokens": int(most_tokens), "do_sample": sampled, "repetition_penalty": float(self.repetition_penalty), **(chosen if sampled else neutral)}
