"""Text functions of prompts and contexts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P

# What a prompt calls each way of discovery.
DESCRIPTIONS = {
    "seed": "seed file (user-provided)", "import": "import graph (strong structural link)", "sibling_match": "test/impl pair",
    "symbol_hit": "symbol match", "same_dir": "same directory", "prefix_match": "name prefix match", "same_module": "same module",
}


def tokens(text: Column) -> Column:
    """An estimate of the token count: a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def indent(line: Column) -> Column:
    """Leading blanks and tabs, each one column."""
    return F.length(F.regexp_extract(line, r"^([ \t]*)", 1))


def quoted(line: Column) -> Column:
    """From the first to the last quote."""
    return F.regexp_extract(line, r'"(.*)"', 1)


def dedupe(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: x != ""))


def joined(values: Column, most: int) -> Column:
    """[a b c], at most `most` of them."""
    return F.concat(F.lit("["), F.array_join(F.slice(values, 1, most), " "), F.lit("]"))


def described(sources: Column) -> Column:
    return F.array_join(F.transform(sources, lambda s: F.coalesce(P.lookup(DESCRIPTIONS, s), s)), ", ")


def score_text(structural: Column, **parts: Column) -> Column:
    """Structural score: 0.50 (discovery=1.00, ...), empty for none; only parts over 0."""
    told = [F.when(c > 0, F.format_string(f"{name}=%.2f", c)) for name, c in parts.items()]
    text = F.concat(F.format_string("Structural score: %.2f (", structural), F.concat_ws(", ", *told), F.lit(")"))
    return F.when((structural > 0) & (F.concat_ws("", *told) != ""), text).otherwise("")


def static_hints(sources: Column, tags: Column, structural: Column, **parts: Column) -> Column:
    score = score_text(structural, **parts)
    return F.concat_ws(
        "\n", F.when(F.size(sources) > 0, F.concat(F.lit("Discovery: "), described(sources))),
        F.when(F.size(tags) > 0, F.concat(F.lit("Heuristic tags: "), joined(tags, 4))), F.when(score != "", score),
    )


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def level_mark(level: Column) -> Column:
    return F.when(level == "error", "❌").when(level == "warning", "⚠️").when(level == "info", "ℹ️").otherwise("•")


# What each kind of judgement asks: the question, its options, the answer's key.
QUESTIONS = {
    "classify_file_role": ("Classify this file's role in relation to the task.", ["main_chain", "companion", "uncertain", "irrelevant"], "classification", ""),
    "judge_relevance": ("Is this file relevant to the task?", ["relevant", "possibly_relevant", "irrelevant"], "relevance", ""),
    "should_expand": (
        "Should we explore the neighbors of this file to find more relevant files?", ["expand", "skip", "uncertain"], "decision",
        "\nConsider:\n- Does this file import or use other modules that might be relevant?\n- Are there related files that could provide important context?\n",
    ),
    "is_implicit_dependency": (
        "Is this file an implicit dependency for the task?\nAn implicit dependency is a file that the task implicitly requires but is not directly mentioned.",
        ["yes", "no", "uncertain"], "is_implicit", "",
    ),
}
# The answers that count as positive.
POSITIVE = {
    "classify_file_role": ["main_chain", "companion"], "judge_relevance": ["relevant", "possibly_relevant"],
    "should_expand": ["expand"], "is_implicit_dependency": ["yes"],
}


def question(kind: str) -> str:
    if kind not in QUESTIONS:
        return "Please analyze this file and provide your assessment."
    ask, options, key, more = QUESTIONS[kind]
    names = ", ".join(f'"{o}"' for o in options)
    form = f'{{\n  "{key}": "<one of the options>",\n  "confidence": <0.0 to 1.0>,\n  "reason": "<optional, brief>"\n}}'
    return f"{ask}\nOptions: {names}\n{more}\nRespond in JSON format:\n{form}"


def prompt(
    task: str, path: Column, lang: Column, module: Column, symbols: Column, neighbors: Column, tags: Column, context: Column,
    seeds: list[str], focus: list[str], kind: str = "classify_file_role",
) -> Column:
    """The prompt of one file; absent parts are left out."""
    some = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c, F.lit("\n")))
    listed = lambda name, c: some(name, F.array_join(c, ", "))
    parts = [
        F.lit(f"## Task\n{task}\n\n## File\n"), F.concat(F.lit("Path: "), path, F.lit("\n")), some("Language", lang), some("Module", module),
        listed("Symbols", symbols), listed("Neighbors", neighbors), listed("Tags", tags), F.lit("\n"),
        F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit("## Context\n"), context, F.lit("\n\n"))),
    ]
    if seeds:
        parts.append(F.lit("## Seed Files\n" + "".join(f"- {s}\n" for s in seeds) + "\n"))
    if focus:
        parts.append(F.lit("## Focus Symbols\n" + ", ".join(focus) + "\n\n"))
    return F.concat_ws("", *parts, F.lit("## Question\n" + question(kind)))


def is_positive(kind: Column, label: Column) -> Column:
    return P.any_of([(kind == k) & label.isin(v) for k, v in POSITIVE.items()])
