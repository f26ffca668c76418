"""Heuristic rule engines: tags, provenance and scores of a path, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P

# The patterns of the basic rules.
TEST = ["_test.", "_tests.", "test_", "tests_", "_unittest.", "_unittests.", "unittest_", "unittests_", "_spec.", "_specs.", "spec_", "specs_",
        "/test/", "/tests/", "/testing/", "\\test\\", "\\tests\\", "\\testing\\"]
CONFIG = ["config", "default", "pref", "settings", "option", "property", "properties"]
CONFIG_EXT = [".json", ".yaml", ".yml", ".toml", ".ini", ".conf", ".config"]
RESOURCE = ["strings", "resources", "i18n", "locale", "locales", "localization", "translations", "messages"]
RESOURCE_EXT = [".grd", ".grdp", ".xtb", ".strings", ".po", ".mo"]
BUILD = ["BUILD", "BUILD.gn", "BUILD.bazel", "CMakeLists", "Makefile", "CMakeLists.txt", "meson.build"]
FLAG = ["feature_flag", "featureflag", "feature-flag", "flags", "flag", "feature_switch", "featureswitch", "experiment", "ab_test"]
# Check, tag, provenance and score of each basic rule, in the order in which scores add up.
BASIC = [
    ("tests", "test_file", "test_rule", 0.3),
    ("default_config", "default_config", "config_rule", 0.4),
    ("resources_or_strings", "resources_or_strings", "resource_rule", 0.3),
    ("build_registration", "build_registration", "build_rule", 0.35),
    ("feature_flag", "feature_flag", "feature_flag_rule", 0.35),
]
CHECKS = [r[0] for r in BASIC]
# The browser settings profile.
PROFILE = "browser_settings"
PAGE = ["settings_page", "settings_ui", "settings_dialog", "settings_component", "settings_view", "settings_container", "options_page", "options_ui",
        "preferences_page", "prefs_page", "_page", "page"]
PAGE_EXT = [".tsx", ".jsx", ".ts", ".js", ".cc", ".cpp", ".h", ".mm"]
HANDLER = ["handler", "controller", "delegate", "manager", "service", "bridge"]
CODE_EXT = [".cc", ".cpp", ".h", ".mm", ".ts", ".tsx", ".js", ".jsx", ".go", ".py", ".java"]
PREFS = ["prefs", "pref_register", "pref_registration", "pref_service", "pref_delegate", "default_pref", "pref_store", "pref_change", "pref_notifier",
         "pref_registry", "config_store", "config_service"]
SETTINGS = ["settings", "options", "preferences", "prefs"]
PROFILE_TEST = ["_test.", "_tests.", "test_", "tests_", "_unittest.", "_unittests.", "_spec.", "_specs.", "_browsertest.", "_browsertests."]
PROFILE_RULES = [
    ("settings_page", "browser_settings:settings_page", 0.5),
    ("handler", "browser_settings:handler", 0.45),
    ("prefs_registration", "browser_settings:prefs_registration", 0.4),
    ("browser_settings_test", "browser_settings:test", 0.3),
]


def is_test(path: Column) -> Column:
    return P.contains_any(F.lower(P.normalize(path)), TEST)


def is_config(path: Column) -> Column:
    low = F.lower(P.normalize(path))
    named = F.exists(F.split(low, "/"), lambda c: P.contains_any(P.strip_ext(c), CONFIG) & ~F.contains(P.strip_ext(c), F.lit("test")))
    return named | (P.ext(low).isin(CONFIG_EXT) & F.contains(low, F.lit("config")))


def is_resource(path: Column) -> Column:
    low = F.lower(P.normalize(path))
    words = [x for w in RESOURCE for x in (f"/{w}/", f"/{w}_", f"_{w}/")]
    parts = F.split(low, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return P.contains_any(low, words) | P.ext(low).isin(RESOURCE_EXT) | F.exists(dirs, P.is_locale)


def is_build(path: Column) -> Column:
    """Case matters."""
    name = P.base(P.normalize(path))
    return name.isin(BUILD) | F.endswith(name, F.lit(".gn")) | F.endswith(name, F.lit(".gni"))


def is_flag(path: Column) -> Column:
    return F.exists(F.split(F.lower(P.normalize(path)), "/"), lambda c: P.contains_any(P.strip_ext(c), FLAG))


def _result(rows: list[tuple[Column, str, str, float]]) -> Column:
    """struct(tags, score, discovered_by); scores are added in the order of the rows and capped at 1."""
    score = F.lit(0.0)
    for hit, _, _, s in rows:
        score = score + F.when(hit, F.lit(s)).otherwise(F.lit(0.0))
    some = lambda k: F.array_compact(F.array(*[F.when(r[0], F.lit(r[k])) for r in rows]))
    return F.struct(some(1).alias("tags"), F.least(score, F.lit(1.0)).alias("score"), some(2).alias("discovered_by"))


def basic_rules(path: Column, checks: list[str] | None = None) -> Column:
    """Unknown checks are ignored; if none is known, all rules apply."""
    known = [c for c in checks or [] if c in CHECKS]
    tests = {"tests": is_test, "default_config": is_config, "resources_or_strings": is_resource, "build_registration": is_build, "feature_flag": is_flag}
    return _result([(tests[c](path), tag, by, s) for c, tag, by, s in BASIC if not known or c in known])


def supported_check(check: str) -> bool:
    return check in CHECKS


def tags_of_check(check: str) -> list[str]:
    return [r[1] for r in BASIC if r[0] == check]


def _parts(path: Column) -> tuple[Column, Column, Column]:
    """(lower path, lower extension, lower name without the extension as it is spelt in lower case)."""
    low = F.lower(P.normalize(path))
    e = P.ext(low)
    name, own = P.base(P.normalize(path)), P.ext(P.normalize(path))
    return low, e, F.when(own == e, P.strip_ext(F.lower(name))).otherwise(F.lower(name))


def profile_page(path: Column) -> Column:
    low, e, name = _parts(path)
    context = P.any_of([F.contains(low, F.lit(f"/{w}/")) | F.contains(low, F.lit(f"/{w}_")) | F.startswith(low, F.lit(f"{w}/")) for w in SETTINGS])
    return context & e.isin(PAGE_EXT) & P.contains_any(name, PAGE)


def profile_handler(path: Column) -> Column:
    low, e, name = _parts(path)
    words = [x for w in [*SETTINGS, "config"] for x in (f"/{w}/", *(f"{w}_{h}" for h in ("handler", "controller", "delegate", "service", "manager")))]
    return P.contains_any(low, words) & e.isin(CODE_EXT) & P.contains_any(name, HANDLER)


def profile_prefs(path: Column) -> Column:
    low, e, name = _parts(path)
    return e.isin(CODE_EXT) & (P.contains_any(name, PREFS) | P.contains_any(low, ["/prefs/", "/pref/", "/preferences/", "/preference/"]))


def profile_test(path: Column) -> Column:
    low = F.lower(P.normalize(path))
    return P.contains_any(low, PROFILE_TEST) & P.contains_any(low, [*SETTINGS, "pref_", "config"])


def matches_profile(name: str) -> bool:
    return name.lower() == PROFILE


def profile_rules(path: Column) -> Column:
    tests = [profile_page, profile_handler, profile_prefs, profile_test]
    return _result([(t(path), *row) for t, row in zip(tests, PROFILE_RULES)])


def symbol_hit(path: Column, symbols: Column, focus: list[str]) -> Column:
    """Whether a focus symbol is in the path or in a symbol, whatever the case."""
    wanted = [f.strip().lower() for f in focus if f.strip()]
    if not wanted:
        return F.lit(False)
    low = F.transform(symbols, F.lower)
    return P.any_of([_hit(path, low, f) for f in wanted])


def _hit(path: Column, low: Column, f: str) -> Column:
    return F.contains(F.lower(path), F.lit(f)) | F.coalesce(F.exists(low, lambda s: F.contains(s, F.lit(f))), F.lit(False))


def pack_test(path: Column, tags: Column) -> Column:
    """A test file as packing sees it."""
    low = F.lower(path)
    ends = ["_test.go", ".test.ts", ".test.tsx", ".spec.ts", ".spec.tsx", "_test.py"]
    named = F.startswith(P.base(low), F.lit("test_")) & F.endswith(low, F.lit(".py"))
    tagged = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ("test_file", "tests", "test")]))
    return tagged | P.any_of([F.endswith(low, F.lit(e)) for e in ends]) | P.contains_any(low, ["/test_", "/test/", "/tests/", "/__tests__/"]) | named


def config_tag(tags: Column) -> Column:
    return F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ("default_config", "config", "configuration")]))
