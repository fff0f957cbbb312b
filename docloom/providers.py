"""Model calls behind one interface, with deterministic offline defaults.

Every call is batch-wise, so that it can run in a pandas function on executors.
A deployment may pass its own provider; no address or key has a default.
"""

from __future__ import annotations

import json
import os
import re
import urllib.request
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?。])\s+")
IDEOGRAPH = re.compile(r"[一-鿿㐀-䶿]")


class Provider:
    """Offline defaults: hashing, counting and rules."""

    def embed(self, texts: list[str], dim: int = 64) -> list[list[float]]:
        """Signed feature hashing of words, unit length; a text without words is all zero."""
        out = np.zeros((len(texts), dim))
        for i, text in enumerate(texts):
            for w, n in Counter(WORD.findall((text or "").lower())).items():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dim] += n if h >> 63 else -n
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    def classify(self, texts: list[str], labels: dict[str, str], default: str | None = None) -> list[str]:
        """The label whose description shares most words with the text."""
        words = {k: set(WORD.findall(f"{k} {v}".lower())) for k, v in labels.items()}
        first = default or next(iter(labels), "")
        out = []
        for text in texts:
            have = set(WORD.findall((text or "").lower()))
            best = max(words, key=lambda k: len(words[k] & have), default=first)
            out.append(best if words and words[best] & have else first)
        return out

    def propose(self, title: str, text: str, most: int = 10, hint: str = "") -> tuple[list[str], list[str]]:
        """First sentences, and the most frequent words; ideographs and short pieces are left out. A model may heed the hint."""
        props = [s.strip() for s in SENTENCE.split((text or "")[:4000]) if len(s.strip()) > 5 and not IDEOGRAPH.search(s)]
        counts = Counter(w for w in WORD.findall(f"{title} {text}".lower()) if len(w) > 2 and not w.isdigit())
        return props[:most], [w for w, _ in counts.most_common(most)]

    def propose_valid(self, title: str, text: str, retries: int = 2) -> tuple[list[str], list[str]]:
        """``propose``, again with a hint while nothing in the right script comes out; the last keywords stay."""
        props, words = [], []
        for attempt in range(retries + 1):
            props, words = self.propose(title, text or "", hint="Answer in the language of the text." if attempt else "")
            props = [p for p in props if len(p.strip()) > 5 and not IDEOGRAPH.search(p)]
            words = [w for w in words if not IDEOGRAPH.search(w)]
            if props:
                break
        return props, words

    def rewrite(self, query: str, attempt: int = 0) -> str:
        """Another wording after a search that found nothing: the longer words, fewer each time."""
        words = sorted(dict.fromkeys(WORD.findall(query)), key=len, reverse=True)
        keep = set(words[: max(1, len(words) - 1 - attempt)])
        return " ".join(w for w in WORD.findall(query) if w in keep) or query

    def split_query(self, query: str, domains: dict[str, str]) -> list[dict]:
        """Sub-queries at conjunctions and question marks, each with the domain that its words name (None if none does)."""
        parts = [p.strip() for p in re.split(r"[?;]|\band\b|\bund\b|\bet\b|그리고", query) if p.strip()]
        return [{"query": p, "domain": self.classify([p], domains, "")[0] or None} for p in parts or [query]]

    def summarize(self, text: str, sentences: int = 3) -> str:
        return " ".join(SENTENCE.split((text or "").strip())[:sentences])

    def describe(self, headers: list[str], rows: int) -> str:
        return f"Table of {rows} rows with the columns {', '.join(headers)}." if headers else f"Image, {rows} parts."

    def plan(self, query: str) -> dict:
        kind = "quantitative" if re.search(r"\b(how many|sum|average|total|count)\b|몇|합계|평균", query, re.IGNORECASE) else "document"
        return {"task_type": kind, "embedding_query": query, "keyword_query": query, "web_query": query}

    def judge(self, query: str, results: list[str], least: float = 0.2) -> list[int]:
        """Numbers (from 1) of the results that share enough words with the query."""
        want = set(WORD.findall(query.lower()))
        return [i + 1 for i, r in enumerate(results) if want and len(want & set(WORD.findall((r or "").lower()))) >= least * len(want)]

    def write(self, query: str, results: list[str], limit: int = 6000) -> str:
        return "\n\n".join(results)[:limit]

    def verify(self, answer: str, context: str) -> str:
        words = WORD.findall(answer.lower())
        have = set(WORD.findall(context.lower()))
        return "PASS" if not words or sum(w in have for w in words) >= 0.5 * len(words) else "RETRY_WRITER"


class HttpProvider(Provider):
    """Embeddings from a server named by DOCLOOM_EMBED_URL; everything else offline."""

    def embed(self, texts: list[str], dim: int = 64) -> list[list[float]]:
        url = os.environ["DOCLOOM_EMBED_URL"]
        out: list[list[float]] = []
        for i in range(0, len(texts), 32):
            body = json.dumps({"input": texts[i : i + 32]}).encode()
            with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=60) as r:
                out += [d["embedding"] for d in json.load(r)["data"]]
        return out


def json_part(text: str, default: dict) -> dict:
    """From the first opening to the last closing brace, else the default."""
    a, b = text.find("{"), text.rfind("}")
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else default
    except ValueError:
        return default


def embedded(df: DataFrame, text: str, into: str = "embedding", provider: Provider | None = None, dim: int = 64) -> DataFrame:
    """Adds vectors, batch by batch on the executors."""
    model = provider or Provider()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.embed([x or "" for x in s], dim))

    return df.withColumn(into, run(F.col(text)))


def proposed(title: Column, text: Column, provider: Provider | None = None) -> Column:
    """struct(propositions, keywords) of a section."""
    model = provider or Provider()

    @F.pandas_udf("propositions array<string>, keywords array<string>")
    def run(t: pd.Series, x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.propose_valid(a or "", b or "") for a, b in zip(t, x)], columns=["propositions", "keywords"])

    return run(title, text)
