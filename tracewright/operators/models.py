"""Model calls behind a client that tests replace: prompts, answers, judges and embeddings."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship


class ModelClient(Protocol):
    def complete(self, messages: list[dict[str, str]]) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class StubClient:
    """Answers from a digest of the prompt, without a network."""

    dims: int = 16

    def complete(self, messages: list[dict[str, str]]) -> str:
        d = hashlib.sha256(json.dumps(messages, sort_keys=True).encode()).digest()
        return json.dumps([{"criterion": f"criterion {d[0] % 7}", "severity": ["high", "medium", "low"][d[1] % 3]}])

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[(b - 127.5) / 127.5 for b in hashlib.sha256(t.encode()).digest()[: self.dims]] for t in texts]


@dataclass
class HttpClient:
    """A server with chat and embedding endpoints."""

    base_url: str
    model: str
    api_key: str = ""
    timeout: float = 300

    def _post(self, path: str, body: dict) -> dict:
        import urllib.request

        request = urllib.request.Request(f"{self.base_url.rstrip('/')}{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.load(r)

    def complete(self, messages: list[dict[str, str]]) -> str:
        answer = self._post("/chat/completions", {"model": self.model, "messages": messages})["choices"][0]["message"]["content"]
        if not answer:
            raise ValueError("empty answer")
        return answer

    def embed(self, texts: list[str]) -> list[list[float]]:
        got = sorted(self._post("/embeddings", {"model": self.model, "input": texts})["data"], key=lambda x: x["index"])
        if len(got) != len(texts) or not all(x["embedding"] for x in got):
            raise ValueError(f"{len(got)} embeddings of {len(texts)} texts")
        return [x["embedding"] for x in got]


def with_retry(call: Callable, attempts: int = 5, first: float = 2, most: float = 60, sleep: Callable[[float], None] = time.sleep):
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(min(most, first * 2**k))


def complete_all(prompts: DataFrame, client: Callable[[], ModelClient], key: str, prompt: str = "prompt", attempts: int = 5) -> DataFrame:
    """(key, answer, model_error): one call a row, tried again when it fails; the last failure is an error of the row, not an end."""
    ship(prompts.sparkSession)
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        for b in batches:
            out = []
            for k, p in zip(b[key], b[prompt], strict=True):
                try:
                    out.append((k, with_retry(lambda p=p: made.complete([{"role": "user", "content": p}]), attempts), None))
                except Exception as e:
                    out.append((k, None, str(e)))
            yield pd.DataFrame(out, columns=[key, "answer", "model_error"])

    return prompts.select(key, prompt).mapInPandas(run, f"{key} {kind}, answer string, model_error string")


def embed_all(rows: DataFrame, client: Callable[[], ModelClient], key: str, text: str, batch: int = 16) -> DataFrame:
    """(key, vector) of every text, in batches."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                yield pd.DataFrame({key: part[key], "vector": with_retry(lambda part=part: made.embed(part[text].tolist()))})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>")
