"""Code context of a prompt: outline and snippets of a file within a token budget.

Choosing windows one after the other, each against those before and against what is left of the
budget, is sequential by nature: one Arrow-batched function per card, on whole columns otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trailhead.functions.extract import DECLARATIONS

# Limits of a context.
READ_BYTES, BEFORE, AFTER = 256 * 1024, 2, 18
SYMBOLS, IMPORTS, DECLS, BLOCK_LINES = 12, 8, 6, 48
SNIPPET_TOKENS, OUTLINE_TOKENS = 48, 24
JS, C = ("js", "jsx", "ts", "tsx"), ("c", "cpp", "h", "hpp")
# The line that names a file's unit, by language: label, beginnings.
UNITS = {
    "go": ("Package", ("package ",)), "py": ("Entrypoint", ("class ", "def ")), "rust": ("Module", ("pub mod ", "mod ")),
    **dict.fromkeys(JS, ("Entrypoint", ("export default ", "export class ", "export function ", "module.exports"))),
}
# Beginnings of import lines, by language.
IMPORT_LINES = {"py": ("import ", "from "), "java": ("import ",), "rust": ("use ",), **dict.fromkeys(C, ("#include ",))}


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def collapse(line: str) -> str:
    return " ".join(line.split())


@dataclass
class Source:
    lines: list[str]
    lang: str

    def line_of(self, symbol: str, mention: bool = True) -> int:
        """Where the symbol is declared, else mentioned; -1. Lines beyond what is read do not count."""
        q = re.escape(symbol)
        tests = [re.compile("|".join(f"(?:{d.format(q)})" for d in DECLARATIONS), re.ASCII).search]
        if mention:
            tests += [re.compile(rf"\b{q}\b", re.ASCII).search, lambda x: symbol.lower() in x.lower()]
        return next((i for t in tests for i, x in enumerate(self.lines) if t(x)), -1) if symbol else -1

    def braces(self, at: int) -> tuple[int, int] | None:
        depth, opened = 0, False
        for i, x in enumerate(self.lines[at : at + BLOCK_LINES], at):
            depth += x.count("{") - x.count("}")
            opened |= "{" in x
            if opened and depth <= 0:
                return at, i + 1
        return None

    def indented(self, at: int) -> tuple[int, int] | None:
        """A block after a line that ends in a colon: all lines indented more, and blank ones."""
        if not self.lines[at].strip().endswith(":"):
            return None
        depth = lambda x: len(x) - len(x.lstrip(" \t"))
        inside, end = False, at + 1
        for i in range(at + 1, min(len(self.lines), at + BLOCK_LINES)):
            x = self.lines[i]
            if x.strip() and depth(x) <= depth(self.lines[at]):
                break
            inside |= bool(x.strip())
            end = i + 1
        return (at, end) if inside else None

    def window(self, at: int) -> tuple[int, int]:
        if block := self.braces(at) or self.indented(at):
            return max(0, block[0] - BEFORE), min(len(self.lines), block[1] + 1)
        start, end = max(0, at - BEFORE), min(len(self.lines), at + AFTER)
        while start > 0 and self.lines[start - 1].strip():
            start -= 1
        while end < len(self.lines) and self.lines[end].strip():
            end += 1
        return start, end

    def render(self, label: str, start: int, end: int) -> str:
        part = self.lines[start:end]
        while part and not part[0].strip():
            part = part[1:]
        while part and not part[-1].strip():
            part = part[:-1]
        return f"[{label}]\n```{self.lang}\n" + "\n".join(part) + "\n```" if part else ""

    def unit(self) -> str:
        trimmed = [x.strip() for x in self.lines]
        if self.lang in UNITS:
            label, starts = UNITS[self.lang]
            hit = next((x for x in trimmed if x.startswith(starts)), "")
            return f"{label}: {collapse(hit.removeprefix('package ') if self.lang == 'go' else hit)}" if hit else ""
        if self.lang == "java":
            hit = next((x for x in trimmed if "class " in x or "interface " in x), "")
            return f"Type: {collapse(hit)}" if hit else ""
        if self.lang in C:
            hit = next((x for x in trimmed if x and not x.startswith(("//", "/*", "#include"))), "")
            return f"Decl: {collapse(hit)}" if hit else ""
        return ""

    def import_hints(self) -> list[str]:
        trimmed = [x.strip() for x in self.lines]
        if self.lang == "go":
            found, block = [], False
            for x in trimmed:
                if x == "import (" or block and x == ")":
                    block = not block
                elif (block or x.startswith("import ")) and x.count('"') > 1:
                    found.append(x[x.index('"') + 1 : x.rindex('"')])
            found = [x for x in found if x]
        elif self.lang in JS:
            found = [collapse(x) for x in trimmed if x.startswith("import ") or x.startswith("export ") and " from " in x]
        else:
            found = [collapse(x) for x in trimmed if x.startswith(IMPORT_LINES.get(self.lang, ("\0",)))]
        return list(dict.fromkeys(found[:IMPORTS]))


def prioritized(focus: list[str], own: list[str]) -> list[str]:
    """Focus symbols first, then the file's own up to the limit."""
    out = dict.fromkeys(x.strip() for x in focus if x.strip())
    for s in own:
        if len(out) >= SYMBOLS:
            break
        if s.strip():
            out[s.strip()] = None
    return list(out)


def outline(src: Source, symbols: list[str]) -> str:
    parts = [src.unit()]
    if found := src.import_hints():
        parts.append("Imports: " + ", ".join(found))
    decls = [collapse(src.lines[i]) for s in symbols if (i := src.line_of(s, mention=False)) >= 0]
    decls = list(dict.fromkeys(d for d in decls if d))[:DECLS]
    if decls:
        parts += ["Relevant declarations:", *[f"- {d}" for d in decls]]
    parts = [p for p in parts if p]
    return "\n".join(["File outline:", *parts]) if parts else ""


def snippets(src: Source, symbols: list[str], budget: int) -> str:
    """Windows of symbols that overlap none before; the first that is too long is shortened to fit and is the last."""
    windows: list[tuple[str, int, int]] = []
    for s in symbols:
        if (at := src.line_of(s)) >= 0:
            start, end = src.window(at)
            if all(end <= a or start >= b for _, a, b in windows):
                windows.append((s, start, end))
    windows = windows or [("file_excerpt", 0, min(len(src.lines), AFTER + 6))]
    parts = ["Relevant code snippets:"]
    left = budget - tokens(parts[0])
    for label, start, end in windows:
        if left <= 0:
            break
        block = src.render(label, start, end)
        if tokens(block) <= left:
            parts.append(block)
            left -= tokens(block)
            continue
        short = next((b for e in range(end, start + 3, -1) if (b := src.render(label, start, e)) and tokens(b) <= left), "")
        if short:
            parts.append(short)
            break
    return "\n\n".join(parts) if len(parts) > 1 else ""


def task_context(content: str | None, lang: str, symbols: list[str], hints: str, focus: list[str], budget: int) -> str:
    """Static hints, then outline, then snippets, as far as the budget goes."""
    left = budget - tokens(hints)
    if budget <= 0 or left <= 0:
        return ""
    sections = [hints] if hints else []
    if content:
        text = content.encode()[:READ_BYTES].decode(errors="ignore")
        src = Source(text.split("\n"), lang)
        order = prioritized(focus, symbols)
        parts, used = [], 0
        if left >= OUTLINE_TOKENS and (told := outline(src, order)) and tokens(told) <= left:
            parts, used = [told], tokens(told)
        if left - used >= SNIPPET_TOKENS and (code := snippets(src, order, left - used)):
            parts.append(code)
        if parts:
            sections.append("\n\n".join(parts))
    return "\n\n".join(sections).strip()


def context_column(content: Column, lang: Column, symbols: Column, hints: Column, budget: Column, focus: list[str]) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for c, l, s, h, b in batches:
            yield pd.Series([task_context(x, y, list(z), w, focus, int(n)) for x, y, z, w, n in zip(c, l, s, h, b)])

    return run(content, lang, symbols, hints, budget)
