"""Sinks: a pack as JSON or Markdown, metrics as text."""

from __future__ import annotations

import json
import os
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row

# Marks of risk levels.
MARKS = {"error": "❌", "warning": "⚠️", "info": "ℹ️"}


def plain(row: Row) -> dict:
    return row.asDict(recursive=True)


def pack_json(pack: DataFrame) -> str:
    """One pack, indented by two; absent values are left out, the three main lists never."""
    raw = plain(pack.first())
    always = {"main_chain", "companion_files", "reading_order", "task", "stats"}
    return json.dumps({k: v for k, v in raw.items() if k in always or v}, indent=2, ensure_ascii=False)


@dataclass
class Markdown:
    stats: bool = True
    uncertain: bool = True
    max_main: int = 0
    max_companion: int = 0
    max_order: int = 0

    def render(self, pack: DataFrame) -> str:
        p = plain(pack.first())
        out = ["# Trailhead ContextPack\n\n## Task Summary\n\n" + p["task"] + "\n\n"]
        if p.get("repo_family"):
            out.append(f"**Repo Family:** {p['repo_family']}\n\n")
        out.append(self._listed("Recommended First Reads", "These files form the **main execution path** relevant to your task. Start here to understand the core logic:", p["main_chain"], self.max_main))
        out.append(self._listed("High-Priority Companion Files", "These files provide **supporting context** such as configurations, types, and helpers:", p["companion_files"], self.max_companion))
        if self.uncertain and p["uncertain_nodes"]:
            files = "".join(f"- `{f}`\n" for f in p["uncertain_nodes"])
            out.append(f"## Uncertain Points\n\nThese files **might be relevant** but require manual review:\n\n{files}\n")
        out.append(self._listed("Recommended Reading Order", "For best results, read files in this order:", p["reading_order"], self.max_order))
        if p["risk_hints"]:
            out.append("## Risk Hints\n\n" + "".join(self._hint(h) for h in p["risk_hints"]) + "\n")
        if self.stats:
            s = p["stats"]
            model = "Yes" if s["model_enhanced"] else "No (static analysis only)"
            out.append(
                f"## Statistics\n\n- **Total files analyzed:** {s['total_files']}\n- **Main chain files:** {s['main_chain_count']}\n"
                f"- **Companion files:** {s['companion_count']}\n- **Uncertain files:** {s['uncertain_count']}\n- **Model enhanced:** {model}\n\n"
            )
        return "".join(out)

    @staticmethod
    def _listed(title: str, intro: str, files: list[str], most: int) -> str:
        if not files:
            return ""
        shown = files[:most] if most > 0 else files
        body = "".join(f"{i}. `{f}`\n" for i, f in enumerate(shown, 1))
        more = f"\n*...and {len(files) - len(shown)} more files*\n" if len(shown) < len(files) else ""
        return f"## {title}\n\n{intro}\n\n{body}{more}\n"

    @staticmethod
    def _hint(h: dict) -> str:
        files = "".join(f"    - `{f}`\n" for f in h["affected_files"])
        return f"{MARKS.get(h['level'], '•')} **[{h['level']}] {h['category']}:** {h['message']}\n" + (f"  - Affected files:\n{files}" if files else "") + "\n"


def emit(text: str, path: str = "") -> None:
    """To a file, or to standard output."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)


def eval_text(summary: Row, samples: list[Row]) -> str:
    """Metrics of an evaluation; a report is small, so its rows are on the driver."""
    s = summary.asDict()
    out = [f"=== Evaluation Results ===\n\nTotal Samples: {s['total_samples']}\nSuccessful: {s['success_count']}\nErrors: {s['error_count']}\n\n--- Aggregate Metrics ---\n"]
    names = {"recall_at_10": "Recall@10", "recall_at_20": "Recall@20", "recall_all": "Recall (All)", "precision_at_10": "Precision@10", "precision_at_20": "Precision@20"}
    out += [f"{f'Mean {n}:':<20}{s[f'mean_{k}'] * 100:.2f}%\n" for k, n in names.items()]
    out.append("\n--- Sample Details ---\n\n")
    for r in samples:
        if r.error:
            out.append(f"[{r.sample_id}]\n  ERROR: {r.error}\n\n")
        else:
            out.append(
                f"[{r.sample_id}]\n  Recall@10: {r.recall_at_10 * 100:.2f}%  Recall@20: {r.recall_at_20 * 100:.2f}%  Recall: {r.recall_all * 100:.2f}%\n"
                f"  Hits: {r.hits}  Misses: {r.misses}  Extras: {r.extras}\n\n"
            )
    return "".join(out)


def eval_json(summary: Row, samples: list[Row]) -> str:
    """The same metrics as JSON: the summary and a list of samples."""
    return json.dumps({"summary": summary.asDict(recursive=True), "samples": [r.asDict(recursive=True) for r in samples]}, indent=2, ensure_ascii=False)


class Progress:
    """Phases as Spark job descriptions and, unless quiet, as lines on standard error; colours where a terminal wants them."""

    def __init__(self, spark, quiet: bool = False, colour: bool | None = None):
        self.sc, self.quiet = spark.sparkContext, quiet
        self.colour = sys.stderr.isatty() and "NO_COLOR" not in os.environ if colour is None else colour

    def start(self, what: str) -> None:
        self.sc.setJobDescription(what)
        self.say(what)

    def done(self, what: str, n: int | None = None) -> None:
        self.say(f"done: {what}" + (f" ({n})" if n is not None else ""))

    def say(self, text: str) -> None:
        if not self.quiet:
            print(f"\033[36m{text}\033[0m" if self.colour else text, file=sys.stderr)
