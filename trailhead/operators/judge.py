"""Model judgements: a bounded parallel map over prompts, with isolated errors, and their parsing."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead import ship
from trailhead.functions.text import QUESTIONS

# Fixed value: the system prompt where none is given.
SYSTEM = (
    "You are a code relevance classifier. Given a file and a task description, classify the file's role in relation to the task.\n"
    "Respond only with valid JSON matching the requested format. Do not add any explanation outside the JSON object."
)


def load_system_prompt(path: str | None) -> str:
    if path and os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or SYSTEM
    return SYSTEM


def first_object(text: str) -> str:
    """The first balanced JSON object of a text, strings and escapes minded; {} if there is none."""
    start = text.find("{")
    depth, quoted, skip = 0, False, False
    for i in range(start if start >= 0 else len(text), len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return "{}"


def parse_judgement(kind: str, text: str) -> dict:
    """label, confidence and reason; values of the wrong type are left out. Raises for malformed JSON."""
    raw = json.loads(first_object(text))
    key = QUESTIONS[kind][2] if kind in QUESTIONS else ""
    label, conf, reason = raw.get(key), raw.get("confidence"), raw.get("reason")
    number = isinstance(conf, int | float) and not isinstance(conf, bool)
    return {
        "label": label if isinstance(label, str) else "", "confidence": float(conf) if number else 0.0,
        "reason": reason if isinstance(reason, str) else "",
    }


@dataclass(frozen=True)
class HttpAdapter:
    """A chat-completions endpoint; called on executors."""

    base_url: str
    model: str = "gpt-4"
    api_key: str = ""
    timeout: float = 30.0
    system: str = SYSTEM

    def available(self) -> bool:
        return bool(self.base_url)

    def __call__(self, kind: str, prompt: str) -> str:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "stream": False, "options": {"temperature": 0.3}})
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(f"{self.base_url}/chat/completions", body.encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as got:
            answer = json.loads(got.read())
        if answer.get("error"):
            raise ValueError(f"API error: {answer['error'].get('message')}")
        if not answer.get("choices"):
            raise ValueError("no choices in response")
        return answer["choices"][0]["message"]["content"]


@dataclass
class MockAdapter:
    """Canned replies by kind, or a function of (kind, prompt)."""

    replies: dict[str, str] = field(default_factory=dict)
    reply: Callable[[str, str], str] | None = None
    on: bool = True

    def available(self) -> bool:
        return self.on

    def __call__(self, kind: str, prompt: str) -> str:
        if self.reply is not None:
            return self.reply(kind, prompt)
        if kind in self.replies:
            return self.replies[kind]
        key = QUESTIONS[kind][2] if kind in QUESTIONS else "classification"
        return json.dumps({key: QUESTIONS[kind][1][0] if kind in QUESTIONS else "uncertain", "confidence": 0.5})


RESULT = "idx long, path string, label string, confidence double, reason string, error string"


def judge(prompts: DataFrame, adapter: Callable[[str, str], str] | None, kind: str = "classify_file_role", max_concurrency: int = 4, stop_on_error: bool = False) -> DataFrame:
    """(idx, path, label, confidence, reason, error) for prompts (idx, path, prompt).

    The rows are dealt to at most `max_concurrency` tasks, which bounds calls in flight on the whole
    cluster; idx restores the order. An error stays in its row. With `stop_on_error` a task
    stops calling after its first error and says so in its other rows. Without an adapter every
    row gets an uncertain 0.5.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = False
        for frame in frames:
            rows = []
            for idx, path, prompt in zip(frame.idx, frame.path, frame.prompt):
                row = {"label": "", "confidence": 0.0, "reason": "", "error": None}
                if stopped:
                    row["error"] = "stopped after an error"
                elif adapter is None:
                    row |= {"label": "uncertain", "confidence": 0.5}
                else:
                    try:
                        row |= parse_judgement(kind, adapter(kind, prompt))
                    except Exception as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                        stopped = stop_on_error
                rows.append({"idx": idx, "path": path} | row)
            yield pd.DataFrame(rows, columns=["idx", "path", "label", "confidence", "reason", "error"])

    ship(prompts.sparkSession)
    return prompts.select("idx", "path", "prompt").repartition(max(1, max_concurrency), "idx").mapInPandas(run, RESULT)


def judge_sequentially(prompts: DataFrame, adapter, kind: str = "classify_file_role", stop_on_error: bool = True) -> DataFrame:
    return judge(prompts, adapter, kind, 1, stop_on_error)


def judge_with_callback(prompts: DataFrame, adapter, done: Callable[[int, dict], None], kind: str = "classify_file_role", max_concurrency: int = 4) -> int:
    """Call `done(idx, result)` on the driver as results come in; the number of results. A few at a time are on the driver."""
    n = 0
    with ThreadPoolExecutor(1) as pool:
        for r in judge(prompts, adapter, kind, max_concurrency).toLocalIterator(prefetchPartitions=True):
            pool.submit(done, r.idx, r.asDict()).result()
            n += 1
    return n


def pool_counts(results: DataFrame) -> DataFrame:
    """total, succeeded and failed, and the failed idx in order."""
    bad = F.col("error").isNotNull()
    return results.agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("succeeded"), F.count_if(bad).alias("failed"),
        F.array_sort(F.collect_list(F.when(bad, F.col("idx")))).alias("failed_idx"),
    )


def write_back(cards: DataFrame, results: DataFrame) -> DataFrame:
    """Cards with llm_label and llm_conf of judgements without an error."""
    good = results.where("error is null").select("path", F.col("label").alias("llm_label"), F.col("confidence").alias("llm_conf"))
    return cards.drop("llm_label", "llm_conf").join(good, "path", "left")
