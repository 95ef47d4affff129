"""The three model calls as replaceable providers, with deterministic built-ins."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = dict[str, str]


def tag(passages: DataFrame, tagger: Callable[[str], list[tuple[str, str, str]]], drop: tuple[str, ...] = ("ORDINAL", "CARDINAL")) -> DataFrame:
    """``passage_id, sentence, entity, label`` by a tagger ``text -> [(sentence, entity, label)]``; keys travel with the rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *r) for k, t in zip(b["hash_id"], b["text"], strict=True) for r in (tagger(t) if t else ())]
            yield pd.DataFrame(rows, columns=["passage_id", "sentence", "entity", "label"])

    out = passages.select("hash_id", "text").mapInPandas(run, "passage_id string, sentence string, entity string, label string")
    return out.where(~F.col("label").isin(*drop))


_NAME = r"\p{Lu}[\p{L}\p{M}’']+(?:[ -](?:(?:of|and|the|de|la|der|von) )*\p{Lu}[\p{L}\p{M}’'.]*)*"


def capital_tagger(text: str) -> list[tuple[str, str, str]]:
    """Built-in stand-in for a tagger: runs of capitalised words, and bare numbers, of every sentence."""
    import regex

    out = []
    for sentence in filter(str.strip, regex.split(r"(?<=[.!?。！？।])\s+|\n\s*\n", regex.sub(r"^\s*\d+:", "", text))):
        out += [(sentence.strip(), name, "TERM") for name in regex.findall(_NAME, sentence)]
        out += [(sentence.strip(), number, "CARDINAL") for number in regex.findall(r"(?<!\w)\d+(?!\w)", sentence)]
    return out


def hash_encoder(dim: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """Unit vectors from hashed terms; equal on every worker and machine."""

    def encode(texts: pd.Series) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1.0, n)

    return encode


def embed(texts: DataFrame, encoder: Callable[[], Callable[[pd.Series], np.ndarray]] = hash_encoder, batch: int = 128) -> DataFrame:
    """Adds ``embedding``; `encoder` is called once a worker, so a model is loaded once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for part in parts:
            done = [model(part.iloc[i : i + batch]) for i in range(0, len(part), batch)]
            yield pd.Series(list(np.concatenate(done)) if done else [], index=part.index)

    return texts.withColumn("embedding", run(F.col("text")))


@dataclass(frozen=True)
class ChatClient:
    """A chat-completions endpoint, spoken to with fixed decoding values; certificates are always checked. Failures come back as text, never as errors."""

    url: str
    model: str
    key: str = ""
    timeout: float = 600.0
    tries: int = 3

    @classmethod
    def load(cls, url: str | None = None, model: str | None = None, key: str | None = None) -> ChatClient:
        return cls((url or os.environ.get("LARKSPUR_LLM_URL", "")).rstrip("/"), model or os.environ.get("LARKSPUR_LLM_MODEL", ""), key or os.environ.get("LARKSPUR_LLM_KEY", ""))

    def __call__(self, messages: list[Message], max_tokens: int = 10_000) -> str:
        body = {"model": self.model, "messages": messages, "temperature": 0, "top_p": 1, "seed": 42, "max_tokens": max_tokens}
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        said = ""
        for n in range(1, self.tries + 1):
            try:
                req = urllib.request.Request(f"{self.url}/chat/completions", json.dumps(body).encode(), head)
                with urllib.request.urlopen(req, timeout=self.timeout) as r:
                    return json.load(r)["choices"][0]["message"]["content"]
            except (urllib.error.URLError, TimeoutError, OSError, ValueError, KeyError, IndexError) as e:
                said = f"LLM request failed (retry {n}/{self.tries}): {e}"
        return said

    def reachable(self) -> bool:
        return not self([{"role": "user", "content": "ping"}], 10).startswith("LLM request failed")


def first_passage(messages: list[Message]) -> str:
    """Built-in stand-in for a model: answers with the first sentence of the first passage."""
    text = messages[-1]["content"].split("\n", 1)[0].split(":", 1)[-1]
    return "Answer: " + text.split(". ", 1)[0].strip()


def same_text_judge(messages: list[Message]) -> str:
    """Built-in stand-in for a grading model: compares the last two lines."""
    lines = messages[-1]["content"].split("\n")
    return "correct" if len(lines) > 1 and lines[-1].strip().lower() in lines[-2].strip().lower() else "incorrect"


def infer(df: DataFrame, messages: str, out: str, client: Callable[[list[Message]], str], workers: int = 8) -> DataFrame:
    """Adds column `out` by calling `client` on the chat in column `messages`, with a bounded pool in every task."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                chats = [[{"role": m["role"], "content": m["content"]} for m in c] for c in b[messages]]
                yield b.assign(**{out: list(pool.map(client, chats))})

    return df.mapInPandas(run, schema)
