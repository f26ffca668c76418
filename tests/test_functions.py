"""Column functions against tables of expectations."""

import pytest
from pyspark.sql import functions as F

from trailhead.functions import extract as X
from trailhead.functions import paths as P
from trailhead.functions import rules as R
from trailhead.functions import text as T


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    out = df.coalesce(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()
    return [tuple(r) if len(cols) > 1 else r[0] for r in out]


LANGS = {
    "main.go": "go", "a/b.TSX": "tsx", "x.mjs": "js", "y.cts": "ts", "z.h": "c", "z.inc": "cpp", "s.pyw": "py", "k.kts": "kotlin", "Rakefile.rake": "ruby",
    "q.php5": "php", "e/.env": "dotenv", "CMakeLists.txt": "text", "package.json": "json", "go.mod": "text", "go.sum": "go_sum", "Cargo.toml": "toml",
    "Cargo.lock": "lockfile", "chart.yaml": "yaml", "Dockerfile": "dockerfile", "Dockerfile.prod": "dockerfile", "Makefile": "makefile", "Makefile.am": "makefile",
    "Vagrantfile": "ruby", "Jenkinsfile": "groovy", ".gitignore": "gitignore", "d/.eslintrc": "json", "LICENSE": "text", "unknown.xyz": "text", "noext": "text",
    "a.b/file": "text", "image.PNG": "image", "lib.so": "binary", "fix.diff": "patch", ".travis.yml": "yaml", "APKBUILD": "shell",
}


def test_language(spark):
    assert dict(zip(LANGS, values(spark, list(LANGS), "path string", P.language(F.col("path"))))) == LANGS


def test_kinds_of_files(spark):
    got = values(spark, ["a.go", "a.json", "x/agent/a.go", "api.pb.go", "mod_gen.go"], "p string", P.is_source(F.col("p")), P.is_config(F.col("p")), P.is_generated(F.col("p")))
    assert got == [(True, False, False), (False, True, False), (True, False, True), (True, False, True), (True, False, True)]


MODULES = [("main.go", ""), ("a/x.go", "a"), ("a/b/x.go", "a/b"), ("a/b/c/x.go", "a/b"), ("a\\b\\x.go", "a/b"), ("./a/x.go", "a"), ("a//b/x.go", "a/b")]


def test_modules(spark):
    m = P.module(F.col("p"))
    assert values(spark, [p for p, _ in MODULES], "p string", m) == [x for _, x in MODULES]
    assert values(spark, ["src/a/b/c.go", "src/x.go", "lib/a/x.go"], "p string", P.module(F.col("p"), 1, ("src/",))) == ["a", "", "lib"]
    got = values(spark, [("a/b", "a"), ("a", "a/b"), ("", "a"), ("a", ""), ("ab", "a")], "x string, y string", P.is_sub_module_of(F.col("x"), F.col("y")), P.shared_depth(F.col("x"), F.col("y")))
    assert got == [(True, 1), (False, 1), (False, 0), (True, 0), (False, 0)]
    assert values(spark, ["", "a", "a/b"], "m string", P.module_depth(F.col("m")), P.parent_module(F.col("m"))) == [(0, ""), (1, ""), (2, "a")]


def test_companions(spark):
    stems = {"Handler_test": "handler", "x.spec": "x", "a_mock": "a", "b_fixture": "b", "b.fixture": "b", "plain": "plain", "a_test_mock": "a_test", "c.tests": "c"}
    assert values(spark, list(stems), "s string", P.companion_stem(F.col("s"))) == list(stems.values())
    pairs = [(".c", ".h", True), (".h", ".cc", True), (".c", ".hpp", False), (".hpp", ".cpp", True), (".h", ".h", False), (".hh", ".c", False)]
    assert values(spark, [p[:2] for p in pairs], "a string, b string", P.is_header_pair(F.col("a"), F.col("b"))) == [p[2] for p in pairs]


LOCALES = {"en": True, "FRA": True, "en-US": True, "zh_hant": True, "ui": True, "dom": True, "src": False, "api": False, "e1": False, "english": False, "a-b": False, "en-us-x": False, "": False, "en\n": False}


def test_locale(spark):
    assert dict(zip(LOCALES, values(spark, list(LOCALES), "s string", P.is_locale(F.col("s"))))) == LOCALES


RULES = [
    ("pkg/auth_test.go", ["test_file"], 0.3), ("latest_x.go", ["test_file"], 0.3), ("internal/config/config.go", ["default_config"], 0.4),
    ("config/test_config.go", ["test_file", "default_config"], 0.7), ("prefix_x.go", ["default_config"], 0.4), ("app/strings/a.txt", ["resources_or_strings"], 0.3),
    ("l/en/x.txt", ["resources_or_strings"], 0.3), ("x.grd", ["resources_or_strings"], 0.3), ("a/BUILD.gn", ["build_registration"], 0.35), ("a/build", [], 0.0),
    ("a/x.gni", ["build_registration"], 0.35), ("a/Feature_Flag.cc", ["feature_flag"], 0.35), ("flagship.go", ["feature_flag"], 0.35), ("main.go", [], 0.0),
    ("test/config/strings_flags/en/BUILD", ["default_config", "resources_or_strings", "build_registration", "feature_flag"], 1.0),
]


def test_basic_rules(spark):
    r = R.basic_rules(F.col("p"))
    got = values(spark, [x[0] for x in RULES], "p string", r["tags"], r["score"])
    assert [(t, pytest.approx(s)) for _, t, s in RULES] == got
    only = R.basic_rules(F.col("p"), ["tests", "nonsense"])
    assert values(spark, ["config/a_test.go"], "p string", only["tags"], only["discovered_by"]) == [(["test_file"], ["test_rule"])]
    every = R.basic_rules(F.col("p"), ["nonsense"])
    assert values(spark, ["config/a_test.go"], "p string", every["tags"]) == [["test_file", "default_config"]]
    assert R.supported_check("tests") and not R.supported_check("x") and R.tags_of_check("feature_flag") == ["feature_flag"]


def test_profile_rules(spark):
    rows = [
        ("ui/settings/settings_page.tsx", ["settings_page"]), ("settings/page.cc", ["settings_page"]), ("ui/settings/readme.md", []),
        ("browser/settings/pref_service.cc", ["handler", "prefs_registration"]), ("x/settings_handler.go", ["handler"]), ("x/prefs/a.py", ["prefs_registration"]),
        ("x/settings_handler_test.cc", ["handler", "browser_settings_test"]), ("main.go", []),
    ]
    assert values(spark, [r[0] for r in rows], "p string", R.profile_rules(F.col("p"))["tags"]) == [r[1] for r in rows]
    assert R.matches_profile("Browser_Settings") and not R.matches_profile("other")


def test_symbol_hit_and_pack_predicates(spark):
    hit = R.symbol_hit(F.col("p"), F.col("s"), ["Auth", " "])
    assert values(spark, [("x/AUTHOR.go", []), ("a", ["reauthorize"]), ("a", ["b"])], "p string, s array<string>", hit) == [True, True, False]
    rows = [("a_test.go", [], True), ("b.SPEC.ts", [], True), ("x/__tests__/y.js", [], True), ("test_a.py", [], True), ("x/test_a.go", [], True), ("test_a.go", [], False), ("z.go", ["tests"], True), ("z.go", ["x"], False)]
    assert values(spark, [r[:2] for r in rows], "p string, t array<string>", R.pack_test(F.col("p"), F.col("t"))) == [r[2] for r in rows]


IMPORTS = [
    ("go", 'package a\nimport "fmt"\nimport (\n\t"os"\n\tx "a/b"\n)\n', ["fmt", "os", "a/b"]),
    ("ts", "import a from './a';\nexport * from \"b\";\nconst c = require('c');\nimport('d');\nimport './bare';\n", ["./a", "b", "c", "d"]),
    ("py", "from .models import X\nfrom ..u import y\nfrom a.b import c\nimport os, sys as s\n  import json\n", [".models", "..u", "a.b", "os", "sys", "json"]),
    ("java", "import static a.b.C;\nimport d.E;\nimport f.*;\n", ["a.b.C", "d.E"]),
    ("rust", "use crate::a::b;\nmod x;\n", ["crate::a::b", "x"]),
    ("cpp", '#include "a/b.h"\n # include <vector>\n', ["a/b.h", "vector"]),
    ("php", "<?php require_once('a.php');\ninclude \"b.php\";", ["a.php", "b.php"]),
    ("ruby", "require 'x'\n", []),
    ("rb", "require 'x'\nrequire_relative 'y'\n", ["x", "y"]),
]


def test_imports(spark):
    assert values(spark, [(l, c) for l, c, _ in IMPORTS], "lang string, c string", X.imports(F.col("c"), F.col("lang"))) == [x for _, _, x in IMPORTS]


SYMBOLS = [
    ("go", "func (s *S) Login() {\n}\nfunc hidden() {}\ntype Handler struct {\n}\nconst Max = 1\nvar Gone string\n", "func:Login type:Handler const:Max var:Gone"),
    ("ts", "export default class A {}\nasync function b() {}\nexport const c = (x) => x\nexport interface D {}\ntype E = string\nconst F_G = 1\n", "class:A func:b func:c interface:D type:E const:F_G"),
    ("cpp", "class A {\n};\nstruct B {\n};\nstatic int Foo(int x) {\n}\n#define MAX 3\nconstexpr int kX = 1;\n", "class:A struct:B func:Foo macro:MAX const:kX"),
    ("py", "class A:\n    def run(self):\n        pass\n    def __init__(self):\n        pass\n    def _p(self):\n        pass\nasync def go():\n    pass\n", "class:A func:run func:go"),
    ("java", "public class A {\n  public void run() {\n    if (x) {\n    }\n  }\n}\ninterface B {\n}\n", "class:A interface:B func:run"),
    ("rust", "pub struct A {\n}\nenum B {\n}\npub trait C {\n}\npub fn d() {}\npub const E: u8 = 1;\n", "struct:A enum:B trait:C func:d const:E"),
    ("text", "class A:\n", ""),
]


def test_symbols(spark):
    told = F.array_join(F.transform(X.symbols(F.col("c"), F.col("lang")), lambda s: F.concat_ws(":", s["kind"], s["name"])), " ")
    assert values(spark, [(l, c) for l, c, _ in SYMBOLS], "lang string, c string", told) == [x for _, _, x in SYMBOLS]
    four = "".join(f"func F{i}() {{\n}}\n" for i in range(4))
    assert values(spark, [four], "c string", F.size(X.symbols(F.col("c"), F.lit("go"), 2))) == [2]


def test_lines_and_symbol_lines(spark):
    assert values(spark, ["line1\nline2\nline3"], "c string", X.lines(F.col("c"), 8)) == [["line1", "li"]]
    assert values(spark, ["a\r\nb\n"], "c string", X.lines(F.col("c"))) == [["a\r", "b", ""]]
    code = "package auth\n// Handler is\ntype Handler struct {\n}\nfunc NewHandler() {\n}\n// see a$b\n"
    rows = [(code, s) for s in ("Handler", "NewHandler", "Missing", "a$b", "PACK", "")]
    assert values(spark, rows, "c string, s string", X.symbol_line(X.lines(F.col("c")), F.col("s"))) == [2, 4, -1, 6, 0, -1]


def test_text(spark):
    assert values(spark, ["", "a", "abcde"], "s string", T.tokens(F.col("s"))) == [0, 1, 2]
    assert values(spark, [' a  "b\t"c" '], "s string", T.collapse(F.col("s")), T.quoted(F.col("s")), T.indent(F.col("s"))) == [('a "b "c"', 'b\t"c', 1)]
    assert values(spark, [(["seed", "x_rule"],)], "s array<string>", T.described(F.col("s")), T.joined(F.col("s"), 1)) == [("seed file (user-provided), x_rule", "[seed]")]
    told = T.score_text(F.col("s"), discovery=F.col("d"), module=F.lit(0.0))
    assert values(spark, [(0.5, 1.0), (0.0, 0.0)], "s double, d double", told) == ["Structural score: 0.50 (discovery=1.00)", ""]
    assert "Options: \"yes\", \"no\", \"uncertain\"" in T.question("is_implicit_dependency") and T.question("x").startswith("Please")
    assert values(spark, [("should_expand", "expand"), ("judge_relevance", "irrelevant")], "k string, l string", T.is_positive(F.col("k"), F.col("l"))) == [True, False]
