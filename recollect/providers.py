"""The plug for a language model: a small protocol and a deterministic offline provider, both working on batches."""

import hashlib
import re
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import AFTER_END, ASKING, BASE, LONG_BYTES, LONG_WORD


class Provider(Protocol):
    def embed(self, texts: pd.Series) -> pd.Series: ...
    def synthesize(self, prompts: pd.Series) -> pd.Series: ...
    def extract_facts(self, texts: pd.Series) -> pd.Series: ...
    def gain(self, queries: pd.Series, documents: pd.Series) -> pd.Series: ...
    def generate(self, prompts: pd.Series) -> pd.Series: ...
    def token_probabilities(self, texts: pd.Series) -> pd.Series: ...
    def count_tokens(self, texts: pd.Series) -> pd.Series: ...


class Offline:
    """``embed`` takes a batch of texts and so is the batched form as well. Needs no network: hashed word vectors, the first sentences as gist, ``X verb Y`` facts, word overlap as gain."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _vector(self, text: str | None) -> list[float] | None:
        if text is None:
            return None
        v = np.zeros(self.dim)
        for w in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).tolist()

    def embed(self, texts: pd.Series) -> pd.Series:
        return texts.map(self._vector)

    def synthesize(self, prompts: pd.Series) -> pd.Series:
        first = lambda p: " ".join(m.split(". ")[0].strip() for m in re.findall(r"\): (.*)", p or ""))
        return prompts.map(first)

    def extract_facts(self, texts: pd.Series) -> pd.Series:
        import json

        def one(t: str | None) -> str:
            found = re.findall(r"\b([A-Z]\w+(?: [A-Z]\w+)*) (lives in|works at|likes|owns|knows|is) ([A-Z]\w+(?: [A-Z]\w+)*)", t or "")
            return json.dumps([{"subject": s, "predicate": p.replace(" ", "_"), "object": o, "confidence": 0.9} for s, p, o in found])

        return texts.map(one)

    def gain(self, queries: pd.Series, documents: pd.Series) -> pd.Series:
        def one(q: str | None, d: str | None) -> float:
            a, b = set(re.findall(r"\w+", (q or "").lower())), set(re.findall(r"\w+", (d or "").lower()))
            return len(a & b) / (len(a) or 1)

        return pd.Series([one(q, d) for q, d in zip(queries, documents)], dtype=float)

    def generate(self, prompts: pd.Series) -> pd.Series:
        return self.synthesize(prompts)

    def token_probabilities(self, texts: pd.Series) -> pd.Series:
        """Per word a struct of token, log_prob and offset (its number); by the rules of ``functions.text.surprisal``."""

        def one(t: str | None) -> list[dict] | None:
            if t is None:
                return None
            words = t.split()
            end = [False, *(w[-1] in ".!?" for w in words)]
            s = [(AFTER_END if e else BASE) + LONG_WORD * (len(w.encode()) > LONG_BYTES) + ASKING * ("?" in w or "!" in w) for w, e in zip(words, end)]
            return [{"token": w, "log_prob": -x, "offset": i} for i, (w, x) in enumerate(zip(words, s))]

        return texts.map(one)

    def count_tokens(self, texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else 0 if not t else max(1, len(t.encode()) // 4))


def embed(provider: Provider, text: Column) -> Column:
    @F.pandas_udf("array<float>")
    def run(t: pd.Series) -> pd.Series:
        return provider.embed(t)

    return run(text)


def synthesize(provider: Provider, prompt: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return provider.synthesize(t)

    return run(prompt)


def extract_facts(provider: Provider, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return provider.extract_facts(t)

    return run(text)


def gain(provider: Provider, query: Column, document: Column) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        return provider.gain(q, d)

    return run(query, document)


def generate(provider: Provider, prompt: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return provider.generate(t)

    return run(prompt)


def token_probabilities(provider: Provider, text: Column) -> Column:
    @F.pandas_udf("array<struct<token: string, log_prob: double, offset: int>>")
    def run(t: pd.Series) -> pd.Series:
        return provider.token_probabilities(t)

    return run(text)


def count_tokens(provider: Provider, text: Column) -> Column:
    @F.pandas_udf("int")
    def run(t: pd.Series) -> pd.Series:
        return provider.count_tokens(t).astype("Int32")

    return run(text)
