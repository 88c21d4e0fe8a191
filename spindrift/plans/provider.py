"""Models behind an interface: embed, generate, stream, chat."""

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import ship


class Provider(Protocol):
    def embed(self, text: str) -> list[float]: ...
    def generate(self, prompt: str) -> str: ...
    def stream(self, prompt: str) -> Iterator[str]: ...
    def chat(self, messages: list[dict]) -> Iterator[str]: ...


class HashingProvider:
    """Deterministic, for tests: words hashed into a vector; generation echoes the prompt's last line."""

    def __init__(self, dims: int = 64, replies: dict[str, str] | None = None):
        self.dims, self.replies = dims, replies or {}

    def embed(self, text: str) -> list[float]:
        v = [0.0] * self.dims
        for w in text.lower().split():
            h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
            v[h % self.dims] += 1.0 if h >> 32 & 1 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    def generate(self, prompt: str) -> str:
        return next((r for k, r in self.replies.items() if k in prompt), prompt.strip().rsplit("\n", 1)[-1])

    def stream(self, prompt: str) -> Iterator[str]:
        yield from self.generate(prompt).split(" ")

    def chat(self, messages: list[dict]) -> Iterator[str]:
        yield from self.stream(messages[-1]["content"])


class HttpProvider:
    """A local model server with /api/tags, /api/embeddings, /api/generate and /api/chat."""

    def __init__(self, url: str, model: str, embedding_model: str, attempts: int = 3, timeout: float = 10):
        self.url, self.model, self.embedding_model, self.attempts, self.timeout = url, model, embedding_model, attempts, timeout

    def _post(self, path: str, body: dict, timeout: float):
        r = urllib.request.Request(self.url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        return urllib.request.urlopen(r, timeout=timeout)

    def ping(self) -> bool:
        with urllib.request.urlopen(self.url + "/api/tags", timeout=self.timeout) as r:
            have = {m["name"].split(":")[0] for m in json.load(r)["models"]}
        return {self.model.split(":")[0], self.embedding_model.split(":")[0]} <= have

    def embed(self, text: str) -> list[float]:
        """Network errors and server errors are tried again, other errors not."""
        for i in range(1, self.attempts + 1):
            try:
                with self._post("/api/embeddings", {"model": self.embedding_model, "prompt": text}, self.timeout) as r:
                    return json.load(r)["embedding"]
            except urllib.error.HTTPError as e:
                if e.code < 500 or i == self.attempts:
                    raise
            except OSError:
                if i == self.attempts:
                    raise
            time.sleep(0.2 * i)
        raise AssertionError

    def generate(self, prompt: str) -> str:
        with self._post("/api/generate", {"model": self.model, "prompt": prompt, "stream": False}, 60) as r:
            return json.load(r)["response"]

    def _lines(self, path: str, body: dict) -> Iterator[dict]:
        with self._post(path, body, 60) as r:
            for line in r:
                got = json.loads(line)
                yield got
                if got.get("done"):
                    return

    def stream(self, prompt: str) -> Iterator[str]:
        for x in self._lines("/api/generate", {"model": self.model, "prompt": prompt, "stream": True}):
            yield x.get("response", "")

    def chat(self, messages: list[dict]) -> Iterator[str]:
        for x in self._lines("/api/chat", {"model": self.model, "messages": messages, "stream": True}):
            yield x.get("message", {}).get("content", "")


def embed_column(df: DataFrame, provider: Provider, text: str = "text") -> DataFrame:
    """df with embedding and error: one client for each task; a text that fails has an error and no vector."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b:
                try:
                    out.append((provider.embed(t), None))
                except Exception as e:  # noqa: BLE001  reported in the row
                    out.append((None, str(e)))
            yield pd.DataFrame(out, columns=["embedding", "error"])

    embed = F.pandas_udf(run, "embedding array<double>, error string")
    return df.withColumn("_e", embed(F.col(text))).select(*df.columns, "_e.embedding", "_e.error")
