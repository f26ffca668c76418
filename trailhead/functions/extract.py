"""Imports and symbols by regular expressions: native, in the order patterns list them, distinct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multi-line with \n alone as the line end, as these patterns expect.
M = "(?md)"
#: White space without the vertical tab.
S = r"[\t\n\f\r ]"
#: ASCII word boundary.
B = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"

# Import patterns by language; group 1 is the import.
IMPORTS = {
    "js": [
        r"(?m)(?:import|export)[^'\"`]*from\s+['\"]([^'\"`]+)['\"]",
        r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
        r"import\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    ],
    "java": [r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;"],
    "rust": [r"(?m)^\s*use\s+([\w:]+)", r"(?m)^\s*mod\s+(\w+)\s*;"],
    "c": [r"(?m)^\s*#\s*include\s+[\"<]([^\">]+)[\">]"],
    "rb": [r"(?m)^\s*require\s+['\"]([^'\"]+)['\"]", r"(?m)^\s*require_relative\s+['\"]([^'\"]+)['\"]"],
    "php": [r"(?m)(?:require|include)(?:_once)?\s*\(?['\"]([^'\"]+)['\"]\)?"],
}
# Import patterns of Go and Python, which are put together below.
GO_SINGLE, GO_BLOCK, GO_QUOTED = r'(?m)^\s*import\s+"([^"]+)"', r"(?s)import\s*\(([^)]+)\)", r'"([^"]+)"'
PY_RELATIVE, PY_FROM = r"(?m)^\s*from\s+(\.+[\w.]*)\s+import", r"(?m)^\s*from\s+([a-zA-Z][\w.]*)\s+import"
PY_PLAIN = r"(?m)^\s*import\s+([\w.,][^\n]*)"
# Symbol patterns by language and kind, in order; group 1 is the name.
SYMBOLS = {
    "go": [
        ("func", r"(?m)^\s*func\s+(?:\([^)]+\)\s+)?([A-Z][a-zA-Z0-9_]*)\s*[\(]"),
        ("type", r"(?m)^\s*type\s+([A-Z][a-zA-Z0-9_]*)\s+(?:struct|interface)"),
        ("const", r"(?m)^\s*const\s+([A-Z][a-zA-Z0-9_]*)\s*="),
        ("var", r"(?m)^\s*var\s+([A-Z][a-zA-Z0-9_]*)\s*[=\s]"),
    ],
    "js": [
        ("class", r"(?m)^\s*(?:export\s+)?(?:default\s+)?class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"),
        ("func", r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"),
        ("func", r"(?m)^\s*(?:export\s+)?const\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_$][a-zA-Z0-9_$]*)\s*=>"),
        ("interface", r"(?m)^\s*(?:export\s+)?interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)"),
        ("type", r"(?m)^\s*(?:export\s+)?type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*="),
        ("const", r"(?m)^\s*(?:export\s+)?const\s+([A-Z_][A-Z0-9_$]*)\s*[=:]"),
    ],
    "c": [
        ("class", r"(?m)^\s*class\s+([A-Z][a-zA-Z0-9_]*)\s*[{:]"),
        ("struct", r"(?m)^\s*struct\s+([A-Z][a-zA-Z0-9_]*)\s*\{"),
        ("func", r"(?m)^\s*(?:static\s+)?(?:inline\s+)?(?:virtual\s+)?[a-zA-Z0-9_:<>\*\&]+\s+([A-Z][a-zA-Z0-9_]*)\s*\([^)]*\)\s*(?:const\s*)?(?:override\s*)?[{;]"),
        ("macro", r"(?m)^\s*#define\s+([A-Z_][A-Z0-9_]*)\b"),
        ("const", r"(?m)^\s*(?:static\s+)?constexpr\s+[a-zA-Z0-9_:<>\*]+\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*="),
    ],
    "py": [
        ("class", r"(?m)^\s*class\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[:\(]"),
        ("func", r"(?m)^\s*(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("),
    ],
    "java": [
        ("class", r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|final\s+)?class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends|implements|\{)"),
        ("interface", r"(?m)^\s*(?:public\s+)?interface\s+([A-Z][a-zA-Z0-9_]*)\s*\{"),
        ("func", r"(?m)^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:final\s+)?[a-zA-Z0-9_<>]+\s+([a-z][a-zA-Z0-9_]*)\s*\("),
    ],
    "rust": [
        ("struct", r"(?m)^\s*(?:pub\s+)?struct\s+([A-Z][a-zA-Z0-9_]*)\s*[{\;]"),
        ("enum", r"(?m)^\s*(?:pub\s+)?enum\s+([A-Z][a-zA-Z0-9_]*)\s*\{"),
        ("trait", r"(?m)^\s*(?:pub\s+)?trait\s+([A-Z][a-zA-Z0-9_]*)\s*\{"),
        ("func", r"(?m)^\s*(?:pub\s+)?(?:async\s+)?fn\s+([a-z_][a-zA-Z0-9_]*)\s*[<(]"),
        ("const", r"(?m)^\s*(?:pub\s+)?const\s+([A-Z_][A-Z0-9_]*)\s*:"),
    ],
}
# Patterns of a symbol's declaration line, then of a mention; {} is the symbol.
DECLARATIONS = [
    r"\bfunc\b[^{{\n]*\b{}\b", r"\b(type|class|struct|interface|enum|trait)\b[^{{\n]*\b{}\b",
    r"\b(const|var|let)\b[^{{\n=]*\b{}\b", r"\b(def|fn)\b[^{{\n]*\b{}\b",
]
#: Languages that share patterns.
FAMILY = {"js": ["js", "jsx", "ts", "tsx"], "c": ["c", "cpp", "h", "hpp"]}


def java_regex(p: str) -> str:
    """One of the patterns above, to the letter of Java's engine."""
    return p.replace("(?m)", M).replace(r"\s", S).replace(r"\b", B).replace(f"[={S}]", r"[=\t\n\f\r ]")


def find_all(text: Column, p: str) -> Column:
    return F.regexp_extract_all(text, F.lit(java_regex(p)), F.lit(1))


def _by_lang(lang: Column, table: dict[str, Column], otherwise: Column) -> Column:
    out = F.when(F.lit(False), otherwise)
    for name, col in table.items():
        out = out.when(lang.isin(FAMILY.get(name, [name])), col)
    return out.otherwise(otherwise)


def _distinct(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def _trimmed(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.regexp_replace(x, rf"^{S}+|{S}+$", "")), lambda x: x != "")


def go_imports(text: Column) -> Column:
    blocks = F.flatten(F.transform(find_all(text, GO_BLOCK), lambda b: find_all(b, GO_QUOTED)))
    return _distinct(find_all(text, GO_SINGLE), blocks)


def python_imports(text: Column) -> Column:
    """Relative froms, absolute froms, then each first word of plain import lists."""
    words = F.flatten(F.transform(find_all(text, PY_PLAIN), lambda m: F.split(m, ",")))
    words = F.transform(_trimmed(words), lambda x: F.substring_index(x, " ", 1))
    return _distinct(_trimmed(F.concat(find_all(text, PY_RELATIVE), find_all(text, PY_FROM), words)))


def imports(text: Column, lang: Column) -> Column:
    """Distinct imports in pattern order; empty for other languages."""
    table = {k: _distinct(*[find_all(text, p) for p in ps]) for k, ps in IMPORTS.items()}
    return _by_lang(lang, {"go": go_imports(text), "py": python_imports(text)} | table, F.array().cast("array<string>"))


def symbols(text: Column, lang: Column, most: int = 100) -> Column:
    """array<struct<name, kind>>: by kind, then place; the first kind of a name counts; at most `most`."""
    none = F.array().cast("array<struct<name:string,kind:string>>")

    def of(rows: list[tuple[str, str]], keep) -> Column:
        every = F.concat(*[_named(find_all(text, p), kind) for kind, p in rows])
        every = F.filter(every, keep)
        names = F.transform(every, lambda s: s["name"])
        return F.slice(F.filter(every, lambda s, i: F.array_position(names, s["name"]) == i + 1), 1, most)

    keep = {
        "py": lambda s: ~((s["kind"] == "func") & F.startswith(s["name"], F.lit("_"))),
        "java": lambda s: ~((s["kind"] == "func") & s["name"].isin("if", "while", "for", "switch")),
    }
    return _by_lang(lang, {k: of(rows, keep.get(k, lambda s: F.lit(True))) for k, rows in SYMBOLS.items()}, none)


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))


def symbol_names(text: Column, lang: Column, most: int = 100) -> Column:
    return F.transform(symbols(text, lang, most), lambda s: s["name"])


def lines(text: Column, byte_limit: int | None = None) -> Column:
    """Split at \\n only; a limit cuts bytes before the split, and half a character becomes U+FFFD. Null gives null."""
    if byte_limit is not None:
        text = F.make_valid_utf8(F.substring(text.cast("binary"), 1, byte_limit).cast("string"))
    return F.split(text, "\n", -1)


def symbol_line(all_lines: Column, symbol: Column) -> Column:
    """The first line (from 0) that declares the symbol, else one that has it as a word, else one that has it at all; -1."""
    quoted = F.regexp_replace(symbol, r"([^0-9A-Za-z_])", r"\\$1")
    declares = F.concat(F.lit("(?:"), *_alternatives(quoted), F.lit(")"))
    word = F.concat(F.lit(B), quoted, F.lit(B))
    at = lambda test: F.array_position(F.transform(all_lines, test), F.lit(True)) - 1
    first, second = at(lambda x: F.rlike(x, declares)), at(lambda x: F.rlike(x, word))
    third = at(lambda x: F.contains(F.lower(x), F.lower(symbol)))
    return F.when(symbol == "", -1).when(first >= 0, first).when(second >= 0, second).otherwise(third).cast("int")


def _alternatives(quoted: Column) -> list[Column]:
    out: list[Column] = []
    for i, d in enumerate(DECLARATIONS):
        before, after = (java_regex(x.replace("{{", "{")) for x in d.split("{}"))
        out += [F.lit(("|" if i else "") + before), quoted, F.lit(after)]
    return out
