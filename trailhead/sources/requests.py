"""Requests, golden samples and configuration."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUDGET = "struct<max_seed_neighbors:int,expand_depth:int,max_output_files:int,max_llm_jobs:int>"
REQUEST = (
    "task string, repo_root string, profile string, seed_files array<string>, focus_symbols array<string>, focus_checks array<string>, "
    f"budget {BUDGET}"
)


@dataclass
class Budget:
    max_seed_neighbors: int = 0
    expand_depth: int = 0
    max_output_files: int = 0
    max_llm_jobs: int = 0


@dataclass
class Request:
    """Unknown keys are ignored; absent ones are empty."""

    task: str = ""
    repo_root: str = ""
    profile: str = ""
    seed_files: list[str] = field(default_factory=list)
    focus_symbols: list[str] = field(default_factory=list)
    focus_checks: list[str] = field(default_factory=list)
    budget: Budget | None = None

    @classmethod
    def parse(cls, text: str | bytes) -> Request:
        raw = json.loads(text)
        known = {f.name: raw[f.name] for f in fields(cls) if raw.get(f.name) is not None}
        if "budget" in known:
            known["budget"] = Budget(**{k: v for k, v in known["budget"].items() if k in {f.name for f in fields(Budget)}})
        out = cls(**known)
        out.validate()
        return out

    @classmethod
    def load(cls, path: str) -> Request:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    def validate(self) -> None:
        if not self.task:
            raise ValueError("task is required")
        if not self.repo_root:
            raise ValueError("repo_root is required")
        for k, v in asdict(self.budget or Budget()).items():
            if v < 0:
                raise ValueError(f"budget.{k} must not be negative")

    @property
    def depth(self) -> int:
        return self.budget.expand_depth if self.budget and self.budget.expand_depth > 0 else 1

    def limit(self, name: str) -> int:
        """A budget's limit; 0 where there is none."""
        return max(0, getattr(self.budget, name)) if self.budget else 0

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if v}, ensure_ascii=False)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REQUEST).json(path, multiLine=True)


FILES = "main_chain array<string>, companion_files array<string>, optional_files array<string>, excluded_files array<string>"


def read_goldens(spark: SparkSession, root: str, sample: str | None = None) -> DataFrame:
    """One row per sample directory: sample_id, meta, request, expected. A missing or malformed file raises when it is read."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)

    def part(file: str, schema: str, to: str) -> DataFrame:
        df = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root}/{sample or '*'}/{file}", multiLine=True)
        return df.select(name.alias("sample_id"), F.struct(*df.columns).alias(to)).where(~F.startswith("sample_id", F.lit(".")))

    meta = part("meta.json", "id string, name string, description string", "meta")
    both = meta.join(part("recon_request.json", REQUEST, "request"), "sample_id", "full")
    return both.join(part("expected_files.json", FILES, "expected"), "sample_id", "full").orderBy("sample_id")


def expected_files(goldens: DataFrame) -> DataFrame:
    """(sample_id, path): main chain and companions."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce("expected.main_chain", none), F.coalesce("expected.companion_files", none))
    return goldens.select("sample_id", F.explode(F.array_distinct(both)).alias("path"))


@dataclass
class Provider:
    base_url: str = ""
    api_key: str = ""
    model: str = "gpt-4"
    api_style: str = "openai"
    system_prompt_path: str = ""


@dataclass
class Runtime:
    max_concurrency: int = 4
    request_timeout_sec: int = 30
    max_input_tokens: int = 4096
    max_candidates: int = 100
    max_output_files: int = 50
    enable_model_rerank: bool = False


@dataclass
class Config:
    provider: Provider = field(default_factory=Provider)
    runtime: Runtime = field(default_factory=Runtime)

    def validate(self) -> None:
        for k in ("max_concurrency", "request_timeout_sec", "max_input_tokens", "max_candidates", "max_output_files"):
            if getattr(self.runtime, k) <= 0:
                raise ValueError(f"runtime.{k} must be positive")
        if self.runtime.enable_model_rerank and not self.provider.base_url:
            raise ValueError("provider.base_url is required for judgements")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    def merge(self, raw: dict) -> None:
        """Override only the keys that `raw` mentions."""
        for part in ("provider", "runtime"):
            own = getattr(self, part)
            for k, v in (raw.get(part) or {}).items():
                if hasattr(own, k):
                    setattr(own, k, v)


NAME = "trailhead.json"
ENV = {"TRAILHEAD_BASE_URL": "base_url", "TRAILHEAD_API_KEY": "api_key", "TRAILHEAD_MODEL": "model"}


def load_config(explicit: str = "", repo_root: str = "", home: str | None = None, env: dict | None = None) -> tuple[Config, list[str]]:
    """Defaults, then the user's file, the repository's dot file, the explicit file and the environment; and what was read."""
    env = dict(os.environ) if env is None else env
    home = os.path.expanduser("~") if home is None else home
    out, read = Config(), []
    for path in [os.path.join(home, ".config", NAME), *([os.path.join(repo_root, "." + NAME)] if repo_root else []), *([explicit] if explicit else [])]:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                out.merge(json.load(f))
            read.append(path)
        elif path == explicit:
            raise FileNotFoundError(path)
    for k, to in ENV.items():
        if env.get(k):
            setattr(out.provider, to, env[k])
    return out, read
