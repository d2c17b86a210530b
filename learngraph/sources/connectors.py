"""Text-generation and embedding connectors: configuration, retries, and replayable back ends.

Calls to a provider run once per partition's client inside ``mapInPandas`` and give raw answers
with a status; parsing is another projection. The caller writes the raw answers before
it goes on, so a retried task never asks again for what is stored (see ``call``'s ``replay``).
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

# Providers in order of precedence and the variables that name their keys and models.
PROVIDERS = (
    ("groq", "GROQ_API_KEY", "GROQ_MODEL", "https://api.groq.com/openai/v1"),
    ("openrouter", "OPENROUTER_API_KEY", "OPENROUTER_MODEL", "https://openrouter.ai/api/v1"),
    ("github", "GITHUB_TOKEN", "GITHUB_MODEL", "https://models.inference.ai.azure.com"),
    ("openai", "OPENAI_API_KEY", "OPENAI_MODEL", "https://api.openai.com/v1"),
)


class RateLimited(Exception):
    """The provider asks to wait."""


@dataclass(frozen=True)
class Provider:
    name: str
    base_url: str
    key: str
    model: str


@dataclass(frozen=True)
class Config:
    """How calls are made. ``routes`` pins single models to other providers."""

    provider: Provider | None = None
    routes: Mapping[str, Provider] = field(default_factory=dict)
    temperature: float = 0.2
    attempts: int = 6
    rate_wait: float = 60.0
    rate_growth: float = 1.5
    rate_cap: float = 600.0
    delay: float = 0.0

    def provider_of(self, model: str | None) -> Provider:
        found = self.routes.get(model or "", self.provider)
        if found is None:
            raise ValueError("no provider is configured")
        return replace(found, model=model) if model else found


def choose_provider(env: Mapping[str, str]) -> Provider | None:
    """The first provider whose key is set; None if none is. Nothing is read at import, nothing exits."""
    for name, key, model, url in PROVIDERS:
        if env.get(key):
            return Provider(name, env.get(f"{name.upper()}_BASE_URL", url), env[key], env.get(model, ""))
    return None


def configuration(env: Mapping[str, str], routed: Mapping[str, str] | None = None) -> Config:
    """A Config from environment variables; ``routed`` maps models to provider names."""
    by_name = {n: Provider(n, env.get(f"{n.upper()}_BASE_URL", u), env[k], env.get(m, "")) for n, k, m, u in PROVIDERS if env.get(k)}
    routes = {model: by_name[name] for model, name in (routed or {}).items() if name in by_name}
    return Config(choose_provider(env), routes, delay=float(env.get("LLM_DELAY_SECONDS", "0") or 0))


def with_retries(ask: Callable[[], str], config: Config, sleep: Callable[[float], None] = time.sleep, *, patient: bool = True) -> str:
    """``ask`` until it answers: other errors and empty answers wait 1, 2, 4, ... seconds, rate limits longer and longer up to a cap (or, if not ``patient``, are raised at once)."""
    wait = config.rate_wait
    if config.delay:
        sleep(config.delay)
    for attempt in range(config.attempts):
        try:
            answer = ask()
            if answer and answer.strip():
                return answer
            raise ValueError("empty answer")
        except RateLimited:
            if attempt + 1 == config.attempts or not patient:
                raise
            sleep(wait)
            wait = min(wait * config.rate_growth, config.rate_cap)
        except Exception:
            if attempt + 1 == config.attempts:
                raise
            sleep(2.0**attempt)
    raise ValueError("no attempt was allowed")


class HttpClient:
    """Chat completions of an OpenAI-like endpoint by the standard library. Not ``patient``: rate limits are left to who calls, as calls within a budget need."""

    def __init__(self, config: Config, *, patient: bool = True) -> None:
        self.config, self.patient = config, patient

    def __call__(self, messages: list[dict], model: str | None, temperature: float) -> str:
        import urllib.error
        import urllib.request

        provider = self.config.provider_of(model)
        body = json.dumps({"model": provider.model, "messages": messages, "temperature": temperature}).encode()
        request = urllib.request.Request(f"{provider.base_url}/chat/completions", body, {"Content-Type": "application/json", "Authorization": f"Bearer {provider.key}"})

        def ask() -> str:
            try:
                with urllib.request.urlopen(request, timeout=120) as r:
                    return json.load(r)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as e:
                if e.code == 429:
                    raise RateLimited from e
                raise

        return with_retries(ask, self.config, patient=self.patient)


def prompt_key(messages: Column, model: Column, temperature: float) -> Column:
    """What identifies a call: one answer is kept per key."""
    return F.sha2(F.concat_ws("\0", messages, F.coalesce(model, F.lit("")), F.lit(str(temperature))), 256)


def call(prompts: DataFrame, client: Callable[[], Callable], *, temperature: float = 0.2, replay: DataFrame | None = None) -> DataFrame:
    """key, batch, model, response, status of prompts (batch, model, messages: a JSON array of role and content).

    ``client`` makes a callable (messages, model, temperature) -> text, once per partition. Prompts whose key stands in
    ``replay`` (key, response, status) take the answer from there and aren't asked. A failing call has status
    ``error: ...`` and a null response; it fails no other.
    """
    keyed = prompts.select("batch", "model", "messages").withColumn("key", prompt_key(F.col("messages"), F.col("model"), temperature))

    def run(frames):
        ask = client()
        for frame in frames:
            out = []
            for messages, model in zip(frame["messages"], frame["model"], strict=True):
                try:
                    out.append((ask(json.loads(messages), model, temperature), "ok"))
                except Exception as e:
                    out.append((None, f"error: {type(e).__name__}: {e}"[:500]))
            yield frame[["key", "batch", "model"]].assign(response=[o[0] for o in out], status=[o[1] for o in out])

    schema = "key string, batch string, model string, response string, status string"
    if replay is None:
        return keyed.mapInPandas(run, schema)
    stored = replay.where("status = 'ok'").groupBy("key").agg(F.max("response").alias("response"))
    again = keyed.join(stored, "key").select("key", "batch", "model", "response", F.lit("ok").alias("status"))
    return again.unionByName(keyed.join(stored.select("key"), "key", "left_anti").mapInPandas(run, schema))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A deterministic embedder without a model: signed hashes of words, at unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


TEXTS, TEXT_BYTES = 256, 1 << 20  # that a worker makes Python strings of at once


def embed_texts(df: DataFrame, texts: Mapping[str, str], model: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> DataFrame:
    """``df`` with embeddings (array<float>) of text columns, given as {new column: text column}, all by one worker a task. The model is made once per partition, null texts embed as empty.

    A worker holds the batch that comes and, of it, the strings and vectors of at most ``TEXTS`` rows, of fewer where texts are long (``TEXT_BYTES`` by the batch's average).
    """
    from collections.abc import Iterator

    outs = list(texts)

    def run(batches):
        encode = model()
        for batch in batches:
            rows = max(1, min(TEXTS, len(batch) * TEXT_BYTES // max(1, batch.nbytes)))
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                yield pa.StructArray.from_arrays([as_lists(encode([t or "" for t in part.field(k).to_pylist()])) for k in range(len(outs))], names=outs)

    def as_lists(vectors) -> pa.ListArray:
        found = np.asarray(vectors, np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    kind = StructType([StructField(out, ArrayType(FloatType())) for out in outs])
    made = F.arrow_udf(run, kind)(F.struct(*[F.col(c).alias(f"t{k}") for k, c in enumerate(texts.values())]))
    return df.withColumns({out: made.getField(out) for out in outs})


def embed(df: DataFrame, text_col: str, out_col: str = "vector", model: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder) -> DataFrame:
    """``df`` with the embedding of one text column (``embed_texts``)."""
    return embed_texts(df, {out_col: text_col}, model)
