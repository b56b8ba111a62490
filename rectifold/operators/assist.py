"""Interfaces to a language-model callable, each with a deterministic offline default. Callables run on the driver over bounded vocabularies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

if TYPE_CHECKING:
    from .rules import Learned, Proposal


class Assistant(Protocol):
    """What a model connector offers: whether it answers, its models, and a JSON answer to a prompt."""

    def available(self) -> bool: ...
    def models(self) -> list[str]: ...
    def ask_json(self, prompt: str) -> dict: ...


class Offline:
    """No model: never available, empty answers."""

    def available(self) -> bool:
        return False

    def models(self) -> list[str]:
        return []

    def ask_json(self, prompt: str) -> dict:
        return {}


class HttpAssistant:
    """A local model server that takes a JSON prompt. Any failure counts as no answer."""

    def __init__(self, url: str = "http://localhost:11434", model: str = "", timeout: float = 20.0):
        self.url, self.model, self.timeout = url.rstrip("/"), model, timeout

    def _call(self, path: str, body: dict | None = None) -> dict:
        from urllib.request import Request, urlopen

        try:
            data = None if body is None else json.dumps(body).encode()
            with urlopen(Request(self.url + path, data, {"Content-Type": "application/json"}), timeout=self.timeout) as r:  # noqa: S310
                return json.loads(r.read())
        except (OSError, ValueError):
            return {}

    def available(self) -> bool:
        return bool(self._call("/api/tags"))

    def models(self) -> list[str]:
        return [m.get("name", "") for m in self._call("/api/tags").get("models", [])]

    def ask_json(self, prompt: str) -> dict:
        got = self._call("/api/generate", {"model": self.model, "prompt": prompt, "format": "json", "stream": False}).get("response", "")
        try:
            out = json.loads(got)
        except ValueError:
            return {}
        return out if isinstance(out, dict) else {}


def ask_vocabulary(assistant: Assistant) -> Callable[[str, list[str]], dict[str, str]]:
    def ask(column: str, words: list[str]) -> dict[str, str]:
        got = assistant.ask_json(f"Map each value of '{column}' to one standard spelling, as JSON: {json.dumps(words, ensure_ascii=False)}") if assistant.available() else {}
        return {str(k): str(v) for k, v in got.items()}

    return ask


def vocabulary_proposals(t: Learned, ask: Callable[[str, list[str]], dict[str, str]]) -> list[Proposal]:
    """Columns of 4 to 100 values and at least 10 cells, at most half numeric: the callable maps their vocabulary; only known, changed words count."""
    from .rules import Edit, Proposal, _count_on_frame
    from .values import lookup

    s = strip(F.col("value"))
    vocab = t.counts.select("column", s.alias("v"), "n").filter("v <> ''").groupBy("column", "v").agg(F.sum("n").alias("n"))
    sizes = vocab.groupBy("column").agg(F.count(F.lit(1)).alias("u"), F.sum("n").alias("n"), F.sum(F.when(F.col("v").rlike(r"^[-+]?\d+(\.\d+)?$"), F.col("n")).otherwise(0)).alias("num"))
    live = [r["column"] for r in sizes.filter("n >= 10 and u between 4 and 100 and num <= 0.5 * n").collect()]
    words: dict[str, list[str]] = {}
    for r in vocab.filter(F.col("column").isin(*live)).orderBy("column", F.desc("n"), "v").collect() if live else []:
        words.setdefault(r["column"], []).append(r["v"])
    exprs = {}
    for c in t.columns:
        if c in words:
            mapping = {k: v for k, v in ask(c, words[c]).items() if k in words[c] and v and v != k}
            if mapping:
                exprs[c] = F.when(~t.touched[c], lookup(strip(F.col(f"`{c}`")), mapping))
    n = _count_on_frame(t, exprs) if exprs else {}
    return [Proposal(f"R9_semantic_vocab_{c}", "R9_semantic_vocabulary", "REVIEW", [c], f"Standardise {n[c]} cells of '{c}'", "vocabulary map", n[c], [Edit(c, e)]) for c, e in exprs.items() if n[c]]


def same_entity(a: str, b: str, assistant: Assistant | None = None) -> bool:
    """Whether two terms mean one entity; False unless a model says so."""
    if assistant is None or not assistant.available():
        return False
    return assistant.ask_json(f"Do '{a}' and '{b}' mean the same? Answer as JSON with key same.").get("same") is True


def enrich(issues: list[dict], assistant: Assistant, limit: int = 10) -> list[dict]:
    """Blends the first `limit` distinct issues with a model's confidence (0.6 to 0.4) and routes them again; the rest stay."""
    seen: dict[tuple, float] = {}
    out = []
    for issue in issues:
        key = (issue.get("issue_type"), issue.get("column"), issue.get("original_value"))
        if key not in seen and len(seen) < limit and assistant.available():
            got = assistant.ask_json(f"Confidence from 0 to 1 that this correction is right, as JSON: {json.dumps(issue, default=str)}")
            c = got.get("confidence")
            if isinstance(c, int | float):
                seen[key] = float(c)
        if key in seen:
            conf = round(0.6 * float(issue.get("correction_confidence") or 0) + 0.4 * seen[key], 3)
            issue = issue | {"correction_confidence": conf, "routing_decision": route(conf, bool(issue.get("is_human_review_required")))}
        out.append(issue)
    return out


def route(confidence: float, human: bool, auto: float = 0.95, suggest: float = 0.70) -> str:
    """The stand-alone router: a human flag always wins."""
    if human:
        return "HUMAN_REVIEW_REQUIRED"
    return "AUTO_CORRECT" if confidence >= auto else "SUGGEST_REVIEW" if confidence >= suggest else "HUMAN_REVIEW_REQUIRED"


def impute_rows(df: DataFrame, column: str, ask: Callable[[dict], str | None]) -> DataFrame:
    """Fills blanks of a column by a callable over the row's other cells, in batches on the executors; no answer leaves the blank."""
    from collections.abc import Iterator

    import pandas as pd

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            gone = pdf[column].isna() | (pdf[column].astype("string").str.strip() == "")
            for i in pdf.index[gone.fillna(True)]:
                answer = ask({k: v for k, v in pdf.loc[i].items() if k != column})
                if answer is not None:
                    pdf.at[i, column] = answer
            yield pdf

    return df.mapInPandas(run, df.schema)


METRIC_UP = {"quality_score": True, "completeness": True, "uniqueness": True, "validity": True, "consistency": True, "accuracy": True, "f1": True, "r2": True, "rmse": False, "mae": False, "issues": False}


def explain_shift(metric: str, before: float, after: float) -> str:
    """What a change of a metric means; errors improve when they fall."""
    d = after - before
    if abs(d) < 1e-9:
        return f"{metric} did not change ({before:g})"
    better = (d > 0) == METRIC_UP.get(metric.lower(), True)
    return f"{metric} {'improved' if better else 'worsened'} from {before:g} to {after:g} ({d:+g})"


def dataset_prompt(question: str, columns: dict[str, str], sample: list[dict]) -> str:
    """The prompt of a question about a table: its columns and a few rows."""
    return f"Columns: {json.dumps(columns)}\nRows: {json.dumps(sample[:5], default=str)}\nQuestion: {question}"


def domain_rules(columns: list[str], configured: dict[str, tuple[float | None, float | None]] | None = None) -> dict[str, tuple[float | None, float | None]]:
    """Bounds for the columns whose name holds a rule's word, longest word first."""
    known = configured or {"age": (0, 120), "percentage": (0, 100), "salary": (0, None)}
    out = {}
    for c in columns:
        for word in sorted(known, key=len, reverse=True):
            if re.search(rf"(?:^|[_\W]){re.escape(word)}(?:$|[_\W])", c.lower()):
                out[c] = known[word]
                break
    return out
