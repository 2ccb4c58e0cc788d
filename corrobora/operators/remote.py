"""Model services over HTTP, as judges and embedders.

A sender is made once per task from plain settings, so nothing unpicklable travels; keys come from the
executors' environment. Replies are written before they are used, as asking twice may answer differently. A
request that fails is its own row's failure, so that no answer already paid for is lost.

With a ledger, a folder that driver and executors share, every answer is kept there as soon as it is in, under a hash
of the service and the request. A task that is run again, or another run, takes it from there: what has been paid for
is not asked again. Equal requests of a run are one. All tasks together keep to one budget of requests a minute.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators import contract, prompts
from corrobora.operators.vectors import unit
from corrobora.tables import fresh, written

INVALID = "model output failed schema validation after one retry"
#: Starts the fallback reason of a row whose request failed; such a row says nothing about its outcome.
UNANSWERED = "the service did not answer: "


class ServiceError(RuntimeError):
    """A service that cannot be reached or refuses a request."""


#: Answers after which a request is sent again, and the longest wait before that in seconds.
BUSY, LONGEST_WAIT = (429, 500, 502, 503, 504), 60.0


def post(url: str, body: dict, key: str | None = None, timeout: int = 120, tries: int = 4, pause: float = 0.5) -> dict:
    """The answer to a request. A service that is busy is asked again, after the time it names or ever longer ones;
    the request carries one identifier all the while, by which a service can tell that it is the same."""
    data = json.dumps(body).encode()
    headers = {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(data).hexdigest()} | ({"Authorization": f"Bearer {key}"} if key else {})
    for k in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers), timeout=timeout) as r:
                return json.loads(r.read())
        except urllib.error.HTTPError as error:
            if error.code not in BUSY or k == tries - 1:
                raise
            named = (error.headers or {}).get("Retry-After", "")
            time.sleep(min(LONGEST_WAIT, float(named) if re.fullmatch(r"\d+(\.\d+)?", named) else pause * 2**k))
        except OSError as error:
            raise ServiceError(f"{url}: {error}") from error
    raise ServiceError(f"{url}: not asked")


@dataclass(frozen=True)
class Chat:
    """A chat service. A parameter that it names as unsupported in a 400 answer is dropped; three attempts at most."""

    url: str
    model: str
    temperature: float = 0
    max_tokens: int = 1024
    key_variable: str = "LLM_API_KEY"
    tries: int = 4
    pause: float = 0.5

    def __call__(self, user: str) -> str:
        body = {"model": self.model, "messages": [{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": user}], "temperature": self.temperature, "max_tokens": self.max_tokens, "response_format": {"type": "json_object"}}
        for _ in range(3):
            try:
                return post(f"{self.url}/v1/chat/completions", body, os.environ.get(self.key_variable), tries=self.tries, pause=self.pause)["choices"][0]["message"]["content"] or ""
            except urllib.error.HTTPError as error:
                said = error.read().decode(errors="replace")
                named = [p for p in ("temperature", "max_tokens", "response_format") if p in body and p in said]
                if error.code != 400 or not named:
                    raise ServiceError(f"{self.url}: {error.code} {said[:200]}") from error
                if named[0] == "max_tokens":
                    body["max_completion_tokens"] = body["max_tokens"]
                del body[named[0]]
        raise ServiceError(f"{self.url}: parameters are refused")


@dataclass(frozen=True)
class LocalChat:
    """A daemon on the executors' own network that serves local models."""

    url: str
    model: str
    temperature: float = 0
    tries: int = 4
    pause: float = 0.5

    def preflight(self) -> list[str]:
        """On the driver, before a run: an error if the daemon is down, a warning if it lacks the model."""
        try:
            with urllib.request.urlopen(f"{self.url}/api/tags", timeout=10) as r:
                known = [m["name"] for m in json.loads(r.read()).get("models", [])]
        except OSError as error:
            raise ServiceError(f"{self.url}: {error}") from error
        return [] if any(n == self.model or n.split(":")[0] == self.model for n in known) else [f"model {self.model} is not among {known}"]

    def __call__(self, user: str) -> str:
        body = {"model": self.model, "stream": False, "format": "json", "options": {"temperature": self.temperature}, "messages": [{"role": "system", "content": prompts.SYSTEM}, {"role": "user", "content": user}]}
        try:
            return post(f"{self.url}/api/chat", body, tries=self.tries, pause=self.pause)["message"]["content"] or ""
        except urllib.error.HTTPError as error:
            raise ServiceError(f"{self.url}: {error.code}") from error


@dataclass(frozen=True)
class HttpEmbedder:
    """An embedding service; vectors are brought to unit length."""

    url: str
    model: str
    key_variable: str = "EMBEDDING_API_KEY"

    def embed(self, texts: list[str]) -> list:
        try:
            found = post(f"{self.url}/v1/embeddings", {"model": self.model, "input": texts}, os.environ.get(self.key_variable))["data"]
        except urllib.error.HTTPError as error:
            raise ServiceError(f"{self.url}: {error.code}") from error
        return [unit(np.array(d["embedding"], np.float32)) for d in sorted(found, key=lambda d: d.get("index", 0))]


class Ledger:
    """Answers by request, one small file each, in a folder that all tasks reach."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder.removeprefix("file:")))

    def _name(self, key: str) -> str:
        return f"{self.root}/{key[:2]}/{key}.json"

    def get(self, key: str):
        try:
            with self.store.open_input_file(self._name(key)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def put(self, key: str, answer) -> None:
        """Whole or not at all; of two attempts at once the later one stays."""
        name = self._name(key)
        self.store.create_dir(os.path.dirname(name), recursive=True)
        made = f"{name}.{uuid.uuid4().hex}"
        with self.store.open_output_stream(made) as f:
            f.write(json.dumps(answer, ensure_ascii=False).encode())
        self.store.move(made, name)


@dataclass(frozen=True)
class Kept:
    """An embedder whose answers are kept in a ledger, one per request of several texts."""

    inner: HttpEmbedder
    folder: str

    def embed(self, texts: list[str]) -> list:
        ledger = Ledger(self.folder)
        key = hashlib.sha256(json.dumps([repr(self.inner), texts], ensure_ascii=False).encode()).hexdigest()
        if (known := ledger.get(key)) is not None:
            return [np.array(v, np.float32) for v in known]
        found = self.inner.embed(texts)
        ledger.put(key, [v.tolist() for v in found])
        return found


@dataclass(frozen=True)
class Sending:
    """How requests leave: the ledger's folder, how many tasks send, and how many requests a minute they may send
    together (0: as many as they can). Each sender has an equal part of the budget, and requests are dealt evenly."""

    ledger: str | None = None
    senders: int = 8
    per_minute: float = 0


def ask(rows: DataFrame, send: Callable[[str], str], prompt: str = "prompt", out: str = "raw", error: str = "error", sending: Sending = Sending()) -> DataFrame:
    """``rows`` with the service's answer to each prompt, or the error that came instead; a null prompt has neither."""
    name, *_ = fresh(rows.columns, "__request")
    keyed = written(rows.withColumn(name, F.sha2(F.concat(F.lit(f"{send!r}\n"), F.col(prompt)), 256)))
    wait = 60 * sending.senders / sending.per_minute if sending.per_minute else 0.0

    def answer(text: str) -> tuple[str | None, str | None]:
        try:
            return send(text), None
        except ServiceError as why:
            return None, f"{UNANSWERED}{why}"
        except urllib.error.HTTPError as why:
            return None, f"{UNANSWERED}{why.code}"
        except Exception as why:  # noqa: BLE001  an answer of another shape is this row's failure
            return None, f"{type(why).__name__}: {why}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ledger, free = Ledger(sending.ledger) if sending.ledger else None, time.monotonic()
        for batch in batches:
            found = []
            for key, text in zip(batch[name], batch["__text"], strict=True):
                raw = ledger.get(key) if ledger else None
                why = None
                if raw is None:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = max(free, time.monotonic()) + wait
                    raw, why = answer(text)
                    if ledger and why is None:
                        ledger.put(key, raw)
                found.append((key, raw, why))
            yield pd.DataFrame(found, columns=[name, "__raw", "__why"])

    requests = keyed.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(prompt).alias("__text"))
    answers = written(requests.repartition(sending.senders, name).sortWithinPartitions(name).mapInPandas(run, f"{name} string, __raw string, __why string"))
    return keyed.join(answers, name, "left").select(*rows.columns, F.col("__raw").alias(out), F.col("__why").alias(error))


def judge(send: Callable[[str], str], sending: Sending = Sending()) -> Callable[..., DataFrame]:
    """A judge for ``assess`` that asks a service: the task, once more with the errors if the answer is no valid
    object, and a fallback reason if that one is not either. A critique is asked once only."""

    def verdicts(outcomes: DataFrame, hits: DataFrame, key: str = "outcome_id", first: DataFrame | None = None) -> DataFrame:
        tasks = prompts.task(outcomes, hits, key)
        if first is not None:
            shown = first.select(key, prompts.judgement(F.col(key)).alias("__first"))
            tasks = tasks.join(shown, key).select(key, prompts.critique(F.col("prompt"), F.col("__first")).alias("prompt"))
        answers = contract.validated(ask(tasks, send, sending=sending))
        columns = [key, "value", "ok", "error"]
        if first is None:
            again = F.col("error").isNull() & ~F.col("ok")
            bad = answers.where(again).select(key, prompts.repair(F.col("prompt"), F.col("errors")).alias("prompt"))
            answers = answers.where(~again).select(*columns).unionByName(contract.validated(ask(bad, send, sending=sending)).select(*columns))
        why = F.when(~F.col("ok"), F.coalesce("error", F.lit(INVALID)))
        return answers.select(
            key,
            F.when(F.col("ok"), F.col("value.coverage")).otherwise("none").alias("coverage"),
            F.when(F.col("ok"), F.col("value.confidence")).otherwise(0.0).alias("confidence"),
            F.when(F.col("ok"), F.col("value.rationale")).otherwise(F.concat(F.lit("Automated fallback: "), why, F.lit("."))).alias("rationale"),
            (~F.col("ok") | F.coalesce("value.needs_review", F.lit(True))).alias("needs_review"),
            F.when(F.col("ok"), F.col("value.evidence")).otherwise(F.array().cast(contract.EVIDENCE)).alias("evidence"),
            why.alias("fallback_reason"),
        )

    return verdicts


# The services' variables, addresses and default models.
CLOUD, CLOUD_KEY, CLOUD_URL = "https://api.openai.com", "OPENAI_API_KEY", "OPENAI_BASE_URL"
DAEMON, DAEMON_URL = "http://127.0.0.1:11434", "OLLAMA_HOST"
MODELS = {("llm", "openai"): "gpt-4o-mini", ("llm", "ollama"): "llama3.2", ("embeddings", "openai"): "text-embedding-3-small", ("llm", "lexical"): "lexical", ("embeddings", "mock"): "mock"}


def model_of(kind: str, settings: dict) -> str:
    """The model that the settings name, or the provider's own."""
    return settings["model"] or MODELS.get((kind, settings["provider"]), settings["provider"])


def _address(variable: str, default: str) -> str:
    url = os.environ.get(variable) or default
    url = url if url.startswith(("http://", "https://")) else f"http://{url}"
    return url.rstrip("/").removesuffix("/v1")


def judge_of(settings: dict, ledger: str | None = None) -> tuple[str | Callable, list[str]]:
    """The judge of a provider with its model, after a pre-flight where there is one, and that one's warnings."""
    sending = Sending(ledger, settings["senders"], settings["perMinute"])
    provider, model = settings["provider"], model_of("llm", settings)
    if provider == "openai":
        if not os.environ.get(CLOUD_KEY):
            raise ServiceError(f"{CLOUD_KEY} is not set")
        return judge(Chat(_address(CLOUD_URL, CLOUD), model, settings["temperature"], settings["maxTokens"], CLOUD_KEY), sending), []
    if provider == "ollama":
        chat = LocalChat(_address(DAEMON_URL, DAEMON), model, settings["temperature"])
        return judge(chat, sending), chat.preflight()
    return provider, []


def embedder_of(settings: dict, ledger: str | None = None) -> str | Callable:
    """A provider's embedder: a name in EMBEDDERS, or what makes one in each task; with a ledger its answers are kept."""
    if settings["provider"] != "openai":
        return settings["provider"]
    if not os.environ.get(CLOUD_KEY):
        raise ServiceError(f"{CLOUD_KEY} is not set")
    made = HttpEmbedder(_address(CLOUD_URL, CLOUD), model_of("embeddings", settings), CLOUD_KEY)
    kept = Kept(made, ledger) if ledger else made
    return lambda: kept
