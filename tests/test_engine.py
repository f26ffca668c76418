"""Operators and plans on small trees, hand-evaluated requests and the oracle queries."""

import json
import os
import sys

import duckdb
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trailhead import cli
from trailhead.functions import paths as P
from trailhead.operators import cards as cards_
from trailhead.operators import context, evaluate, expand, graph, judge, pack, rank
from trailhead.plans import queries, scout
from trailhead.sources import render, tree
from trailhead.sources import requests as rq
from trailhead.streaming.requests import stream_packs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

F1 = {
    "cmd/server/main.go": 'package main\n\nimport "fmt"\n\nfunc main() {\n\tfmt.Println()\n}\n',
    "internal/auth/handler.go": 'package auth\n\nimport (\n\t"errors"\n\t"test-repo/internal/config"\n)\n\ntype Handler struct {\n}\n\nfunc (h *Handler) Login() error {\n\treturn errors.New("x")\n}\n',
    "internal/auth/middleware.go": "package auth\n\nfunc Middleware() {\n}\n",
    "internal/config/config.go": "package config\n\nfunc Config() {\n}\n",
    "pkg/utils/helper.go": "package utils\n\nfunc Helper() {\n}\n",
    "README.md": "# Test\n",
    "go.mod": "module test-repo\n",
}


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def plant(root, files):
    for p, c in files.items():
        os.makedirs(os.path.dirname(root / p), exist_ok=True)
        (root / p).write_text(c)


def edges(spark, files):
    return {(r.src, r.dst) for r in graph.import_edges(table(spark, files)).collect()}


# --- sources


def test_tree(spark, tmp_path):
    plant(tmp_path, {"main.go": "a", ".env": "x", ".github/x.yml": "y", "pkg/__init__.py": "", "_priv/z.go": "z", "a/build/out.go": "n", "lib/build": "kept", ".git/config": "n", "node_modules/p/i.js": "n"})
    os.symlink(tmp_path / "main.go", tmp_path / "link.go")
    got = tree.scan(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.path for r in got] == [".env", ".github/x.yml", "_priv/z.go", "lib/build", "main.go", "pkg/__init__.py"]
    assert {r.path: (r.size, r.content) for r in got}["pkg/__init__.py"] == (0, "")
    assert tree.scan(spark, str(tmp_path), ignore=["pkg", "_priv"], max_depth=1, content=False).count() == 2
    assert tree.is_ignored("vendor") and not tree.is_ignored("src")
    with pytest.raises(Exception):
        tree.scan(spark, str(tmp_path / "missing")).count()


def test_requests_and_config(tmp_path):
    r = rq.Request.parse('{"task": "t", "repo_root": "/r", "extra": 1, "budget": {"expand_depth": 2, "other": 3}}')
    assert r.depth == 2 and r.limit("max_llm_jobs") == 0 and json.loads(r.to_json())["task"] == "t"
    for bad in ('{"repo_root": "/r"}', '{"task": "t"}', '{"task": "t", "repo_root": "r", "budget": {"expand_depth": -1}}'):
        with pytest.raises(ValueError):
            rq.Request.parse(bad)
    home, repo = tmp_path / "h", tmp_path / "r"
    plant(tmp_path, {"h/.config/trailhead.json": '{"provider": {"model": "m1"}, "runtime": {"max_candidates": 7}}', "r/.trailhead.json": '{"provider": {"model": "m2"}}', "x.json": '{"runtime": {"max_concurrency": 9}}'})
    c, read = rq.load_config(str(tmp_path / "x.json"), str(repo), str(home), {"TRAILHEAD_API_KEY": "k"})
    assert (c.provider.model, c.provider.api_key, c.runtime.max_candidates, c.runtime.max_concurrency, len(read)) == ("m2", "k", 7, 9, 3)
    c.validate()
    c.runtime.max_candidates = 0
    with pytest.raises(ValueError):
        c.validate()


# --- graph and expansion


def test_import_graph(spark):
    go = {"cmd/main.go": 'import "github.com/e/app/internal/config"\n', "internal/config/config.go": "", "internal/config/loader.go": "x"}
    assert edges(spark, go) == {("cmd/main.go", "internal/config/config.go"), ("cmd/main.go", "internal/config/loader.go")}
    py = {"pkg/service.py": "from .models import U\nfrom ..utils import h\nfrom . import x\n", "pkg/models.py": "", "utils.py": "", "a/b/c.py": "from ..d import y\n", "a/d/__init__.py": ""}
    assert edges(spark, py) == {("pkg/service.py", "pkg/models.py"), ("pkg/service.py", "utils.py"), ("a/b/c.py", "a/d/__init__.py")}
    ts = {"a/x.ts": "import y from './y';\nimport z from '../lib';\nimport q from 'Pkg/Widget.js';\n", "a/y.tsx": "", "lib/index.ts": "", "w/widget.vue": "", "a/y.ts": ""}
    assert edges(spark, ts) == {("a/x.ts", "a/y.ts"), ("a/x.ts", "lib/index.ts"), ("a/x.ts", "w/widget.vue")}
    c = {"a/x.cc": '#include "b/y.h"\n#include "Foo.h"\n#include <z.h>\n', "a/b/y.h": "", "q/foo.h": "", "q/z.h": ""}
    assert edges(spark, c) == {("a/x.cc", "a/b/y.h"), ("a/x.cc", "q/z.h")}
    other = {"A.java": "import x.y.Widget;\n", "w/widget.go": "", "s.rs": "use crate::net::{a};\nuse super::Net;\n", "n/net.rs": ""}
    assert edges(spark, other) == {("A.java", "w/widget.go"), ("s.rs", "n/net.rs")}


def found(spark, seeds, paths, nbrs=None, **config):
    s = spark.createDataFrame([(p, i) for i, p in enumerate(seeds)], "path string, ord long")
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: r.source for r in expand.expand_round(s, f, nbrs, expand.ExpandConfig(**config)).collect()}


def test_expand_round(spark):
    paths = ["handler_a.go", "x/handler_b.go", "x/other.go", "y/deep/er/z.go", "y/deep/q.go", "x/handler_b_test.go", "x/w.h", "x/w.cc"]
    off = dict(same_dir=False, same_module=False, prefix_match=False)
    assert found(spark, ["x/handler_b.go"], paths) == {
        "x/handler_b.go": "seed", "x/other.go": "same_dir", "x/handler_b_test.go": "same_dir", "handler_a.go": "prefix_match", "x/w.h": "same_dir", "x/w.cc": "same_dir",
    }
    assert found(spark, ["y/deep/q.go"], paths)["y/deep/er/z.go"] == "same_module"
    assert found(spark, ["x/handler_b.go", "x/w.cc"], paths, **off) == {"x/handler_b.go": "seed", "x/w.cc": "seed", "x/handler_b_test.go": "sibling_match", "x/w.h": "sibling_match"}
    assert found(spark, ["ab.go"], ["ab.go", "d/abc.go", "d/ab.go"]) == {"ab.go": "seed"}
    assert found(spark, ["abcd.go"], ["d/abcx.go", "d/abc.go", "d/ab.go"]) == {"abcd.go": "seed", "d/abcx.go": "prefix_match", "d/abc.go": "prefix_match"}
    nb = spark.createDataFrame([("main.go", "util/util.go")], "path string, neighbor string")
    assert found(spark, ["main.go"], ["main.go", "util/util.go"], nb)["util/util.go"] == "import"


def test_expand_pairs_no_seeds_that_share_a_key(spark):
    """Each strategy yields at most a row for each key of a file, however many seeds have that key."""
    rows = [(f"m/d/name_{i % 2}{'_test' * (i % 3 == 0)}.{['cc', 'h', 'go'][i % 3]}{'x' * (i // 60)}", i) for i in range(600)]
    seeds = spark.createDataFrame(rows, "path string, ord long").dropDuplicates(["path"])
    files = expand.described(seeds.select("path"))
    own = expand.described(seeds).join(seeds, "path")
    n = seeds.count()
    assert n == 60
    assert [by(own, files).count() for by in (expand.by_dir, expand.by_module)] == [n, n]
    assert expand.by_prefix(own, files).count() <= 2 * n
    wide = spark.createDataFrame([(f"m/d/{k}/util.{e}", i) for i, (k, e) in enumerate((k, e) for k in range(50) for e in ("cc", "h"))], "path string, ord long")
    near = expand.by_sibling(expand.described(wide).join(wide, "path"), expand.described(wide.select("path")))
    assert near.count() <= 2 * 100 and near.select("path").distinct().count() == 100


def test_expand_round_like_one_by_one(spark):
    """Against the definition, seed by seed and strategy by strategy; many seeds share directories, modules and names."""
    names = ["util", "util_test", "UTIL", "utile", "ut", "main", "main.spec", "mainly"]
    paths = sorted({f"{d}{names[(i * 7 + len(d)) % 8]}.{['cc', 'h', 'go', 'py', 'hpp'][i % 5]}" for i in range(40) for d in ("", "a/", "a/b/", "a/b/c/", "a/b/d/", "z/")})
    seeds = paths[3::9]
    part = lambda p: (p.rpartition("/")[0], "/".join(p.split("/")[:-1][:2]), p.rpartition("/")[2].rpartition(".")[0], p.rpartition(".")[2])
    comp = lambda stem: next((stem.lower().removesuffix(e) for e in P.COMPANIONS if stem.lower().endswith(e)), stem.lower())

    def source(p):
        (d, m, s, e), first = part(p), []
        for q in seeds:
            d2, m2, s2, e2 = part(q)
            size = max(3, len(s2) // 2)
            kin = comp(s) == comp(s2) and (d == d2 or m == m2) and (s.lower() != s2.lower() or "." + e in P.HEADERS.get("." + e2, []) or "." + e2 in P.HEADERS.get("." + e, []))
            tests = [("same_dir", d == d2), ("same_module", m == m2), ("prefix_match", min(len(s), len(s2)) >= 3 and len(s) >= size and s[:size].lower() == s2[:size].lower()), ("sibling_match", p != q and kin)]
            first.append({n: hit for n, hit in tests})
        return lambda on: "seed" if p in seeds else next((n for hits in first for n in on if hits[n]), None)

    names = ["same_dir", "same_module", "prefix_match", "sibling_match"]
    for on in [names, *[[n] for n in names]]:
        want = {p: got for p in paths if (got := source(p)(on))}
        assert found(spark, seeds, paths, **{n: n in on for n in names}) == want


def test_expand_two_rounds_follow_path_order(spark):
    """The second round's seeds try in path order: d/bbbxyz.go is reached by the first one's prefix before the second one's directory."""
    f = ["s.go", "bbbbbb.go", "d/cccccc.go", "d/bbbxyz.go"]
    nb = spark.createDataFrame([("s.go", "d/cccccc.go")], "path string, neighbor string")
    got = expand.expand(["s.go"], spark.createDataFrame([(p,) for p in f], "path string"), nb, 2, 0, 0).orderBy("ord").collect()
    assert [(r.path, r.sources) for r in got] == [("s.go", ["seed", "same_dir"]), ("bbbbbb.go", ["same_dir", "seed"]), ("d/bbbxyz.go", ["prefix_match"]), ("d/cccccc.go", ["import", "seed"])]


def test_cards_keep_texts_of_others_unmoved(spark):
    c = spark.createDataFrame([("a.go", 0, True, ["seed"]), ("gone.go", 1, True, ["seed"])], "path string, ord long, is_seed boolean, sources array<string>")
    f = spark.createDataFrame([("a.go", "package a"), ("b.go", "package b")], "path string, content string")
    out = cards_.build_cards(c, f)
    assert {(r.path, r.content) for r in out.collect()} == {("a.go", "package a"), ("gone.go", None)}
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_expand_budget_and_no_seeds(spark):
    f = spark.createDataFrame([(f"d/{c}.go",) for c in "edcba"], "path string")
    got = expand.expand(["d/c.go", "d/c.go", "gone.go"], f, None, 1, 2).orderBy("ord").collect()
    assert [r.path for r in got] == ["d/c.go", "gone.go", "d/a.go", "d/b.go"]
    assert [r.path for r in expand.expand([], f, None, max_candidates=2).orderBy("ord").collect()] == ["d/a.go", "d/b.go"]
    assert expand.expand(["d/c.go"], f, None, max_candidates=3).count() == 3


# --- end to end


def run_cards(spark, seeds, depth=1, adapter=None):
    config = rq.Config()
    config.runtime.enable_model_rerank = adapter is not None
    request = rq.Request("t", "/r", seed_files=seeds, budget=rq.Budget(expand_depth=depth))
    ranked, enhanced = scout.ranked_files(table(spark, F1), request, config, adapter)
    return ranked.cache(), enhanced


def test_request_of_depth_one(spark):
    ranked, _ = run_cards(spark, ["internal/auth/handler.go"])
    got = {r.path: r for r in ranked.collect()}
    assert {p: r.final for p, r in got.items()} == {"internal/auth/handler.go": 0.5, "internal/config/config.go": 0.38499999999999995, "internal/auth/middleware.go": 0.21999999999999997}
    assert got["internal/config/config.go"].discovered_by == ["import", "config_rule"]
    assert got["internal/auth/handler.go"].symbols == ["Login", "Handler"]
    one = pack.build_pack(ranked, "t").first()
    assert one.reading_order == ["internal/auth/handler.go", "internal/config/config.go", "internal/auth/middleware.go"]
    assert (one.main_chain, one.companion_files, one.uncertain_nodes) == (one.reading_order[:1], one.reading_order[1:2], one.reading_order[2:])
    assert [(h.category, h.affected_files) for h in one.risk_hints] == [("configuration", ["internal/config/config.go"])]
    assert one.stats.total_files == 3 and "- `internal/auth/handler.go`" in one.summary_markdown
    text = render.Markdown().render(pack.build_pack(ranked, "t"))
    assert "1. `internal/auth/handler.go`" in text and "## Uncertain Points" in text
    assert json.loads(render.pack_json(pack.build_pack(ranked, "t")))["main_chain"] == one.main_chain


def test_request_of_depth_two(spark):
    got = {r.path: r for r in run_cards(spark, ["internal/auth/handler.go"], 2)[0].collect()}
    assert {p: round(r.final, 9) for p, r in got.items() if r.final >= 0.5} == {"internal/config/config.go": 0.58, "internal/auth/middleware.go": 0.5, "internal/auth/handler.go": 0.5}
    assert got["internal/auth/handler.go"].rank == 2 and "same_dir" in got["internal/auth/handler.go"].discovered_by


def _role(kind, prompt):
    main = "Path: internal/auth/handler.go\n" in prompt
    return json.dumps({"classification": "main_chain" if main else "irrelevant", "confidence": 1.0})


def test_judged_request(spark):
    ranked, enhanced = run_cards(spark, ["internal/auth/middleware.go"], adapter=judge.MockAdapter(reply=_role))
    got = {r.path: r.final for r in ranked.collect()}
    assert enhanced and got["internal/auth/handler.go"] == pytest.approx(0.22 * 0.35 + 0.65) and got["internal/auth/middleware.go"] == pytest.approx(0.175)


def test_run_scans_a_tree(spark, tmp_path):
    plant(tmp_path, F1)
    one = scout.run(spark, rq.Request("t", str(tmp_path), seed_files=["internal/auth/handler.go"])).first()
    assert one.main_chain == ["internal/auth/handler.go"]


# --- ranking and packing


def cards(spark, rows):
    """rows: (path, final wanted through discovery, is_seed)."""
    df = spark.createDataFrame([(p, i, s, d / 0.35) for i, (p, d, s) in enumerate(rows)], "path string, ord long, is_seed boolean, discovery double")
    none = F.array().cast("array<string>")
    return df.withColumns({"module": F.lit(""), "discovered_by": none, "heuristic_tags": none, "symbols": none, "heuristic": F.lit(0.0), "profile": F.lit(0.0)})


def test_pack_limits(spark):
    ranked = rank.rank_cards(cards(spark, [("a", 0.8, False), ("b", 0.6, True), ("c", 0.4, False), ("d", 0.36, False), ("e", 0.2, False), ("f", 0.05, False)]))
    get = lambda c: [(r.path, r.bucket) for r in pack.pack_files(ranked, c).orderBy("reading_pos").collect()]
    assert get(pack.PackConfig()) == [("b", "main_chain"), ("a", "main_chain"), ("c", "companion"), ("d", "companion"), ("e", "uncertain")]
    assert get(pack.PackConfig(max_main=1, max_companion=1, max_uncertain=0)) == [("a", "main_chain"), ("c", "companion"), ("e", "uncertain")]
    assert [p for p, _ in get(pack.PackConfig(max_total=3))] == ["b", "a", "c"]
    assert rank.top_n(ranked, 0).count() == 0 and rank.top_n(ranked, 2).count() == 2 and rank.above(ranked, 0.3).count() == 4
    assert rank.breakdown(ranked).count() == 6


def test_risk_hints(spark):
    ranked = rank.rank_cards(cards(spark, [(f"m{i}.go", 0.6, False) for i in range(4)]))
    kinds = lambda r: [(h.level, h.category) for h in pack.risk_hints(r).first().risk_hints]
    assert kinds(ranked) == [("warning", "test-coverage")]
    tested = ranked.withColumn("heuristic_tags", F.when(F.col("ord") == 0, F.array(F.lit("test_file"))).otherwise(F.array(F.lit("config"))))
    assert kinds(tested.withColumn("symbols", F.array_repeat(F.lit("s"), 21))) == [("info", "complexity")] * 4 + [("info", "configuration")]


# --- judgements


def test_json_objects():
    cases = {'{"a": 1}': '{"a": 1}', 'x {"a": {"b": "}"}} y': '{"a": {"b": "}"}}', r'{"a": "\"}"} z': r'{"a": "\"}"}', "none": "{}", "": "{}", "{open": "{}"}
    assert {k: judge.first_object(k) for k in cases} == cases
    assert judge.parse_judgement("classify_file_role", '{"classification": 3, "confidence": "x"}') == {"label": "", "confidence": 0.0, "reason": ""}
    assert judge.parse_judgement("should_expand", '{"decision": "skip", "confidence": 1}')["label"] == "skip"
    with pytest.raises(ValueError):
        judge.parse_judgement("should_expand", "{'x'}")


def _flaky(kind, prompt):
    if prompt == "p3":
        raise RuntimeError("refused")
    return '{"classification": "companion", "confidence": 0.9}'


def test_pool(spark):
    prompts = spark.createDataFrame([(i, f"f{i}", f"p{i}") for i in range(10)], "idx long, path string, prompt string")
    got = judge.judge(prompts, judge.MockAdapter(reply=_flaky))
    rows = got.orderBy("idx").collect()
    assert [r.idx for r in rows] == list(range(10)) and [r.idx for r in rows if r.error] == [3]
    c = judge.pool_counts(got).first()
    assert (c.total, c.succeeded, c.failed, c.failed_idx) == (10, 9, 1, [3])
    assert judge.judge_sequentially(prompts, judge.MockAdapter(reply=_flaky)).where("error is not null").count() >= 1
    assert judge.judge(prompts, None).where("label = 'uncertain' and confidence = 0.5").count() == 10
    seen = []
    assert judge.judge_with_callback(prompts, judge.MockAdapter(), lambda i, r: seen.append(i)) == 10 and sorted(seen) == list(range(10))
    assert not judge.HttpAdapter("").available() and judge.load_system_prompt("/none") == judge.SYSTEM


def test_context():
    code = F1["internal/auth/handler.go"]
    told = context.task_context(code, "go", ["Login", "Handler"], "Discovery: seed", [], 400)
    assert told.startswith("Discovery: seed\n\nFile outline:\nPackage: auth\nImports: errors, test-repo/internal/config\nRelevant declarations:\n- func (h *Handler) Login() error {")
    assert "[Login]\n```go\n" in told and context.tokens(told) <= 400
    assert context.task_context(code, "go", [], "", [], 0) == "" and context.task_context(None, "go", [], "h", [], 50) == "h"
    py = context.Source(["class A:", "    def b(self):", "        x = 1", "", "        y = 2", "    z = 3"], "py")
    assert py.indented(1) == (1, 5) and py.braces(1) is None and py.line_of("b") == 1
    long = "\n".join(f"line {i} of some text" for i in range(200))
    assert context.tokens(context.task_context(long, "text", [], "", [], 100)) <= 100


# --- evaluation


def test_metrics(spark):
    ranked = spark.createDataFrame([("s", i, p) for i, p in enumerate("axbyz", 1)] + [("t", i, p) for i, p in enumerate("axbyc", 1)], "sample_id string, pos int, path string")
    want = spark.createDataFrame([(s, p) for s in "st" for p in "abc"], "sample_id string, path string")
    got = {r.sample_id: r for r in evaluate.sample_metrics(ranked, want).collect()}
    s = got["s"]
    assert (s.hits, s.misses, s.extras, s.recall_at_10, s.precision_at_10) == (2, 1, 3, pytest.approx(2 / 3), pytest.approx(0.4))
    assert got["t"].precision_at_10 == pytest.approx(0.6)
    verdicts = {(r.path, r.verdict) for r in evaluate.hit_lists(ranked, want).where("sample_id = 's'").collect()}
    assert verdicts == {("a", "hit"), ("b", "hit"), ("c", "miss"), ("x", "extra"), ("y", "extra"), ("z", "extra")}


def test_goldens(spark, tmp_path):
    for name, root in (("001", "ok"), ("002", "bad")):
        plant(tmp_path, {
            f"{name}/meta.json": json.dumps({"id": name, "name": name}), f"{name}/recon_request.json": json.dumps({"task": "t", "repo_root": root}),
            f"{name}/expected_files.json": json.dumps({"main_chain": ["a"], "companion_files": ["b"]}),
        })

    def runner(request):
        if request.repo_root == "bad":
            raise OSError("no tree")
        return ["a", "x"]

    summary, metrics = scout.evaluate_goldens(spark, str(tmp_path), runner)
    s = summary.first()
    assert (s.total_samples, s.success_count, s.error_count, s.mean_recall_all) == (2, 1, 1, 0.5)
    assert "ERROR: OSError" in render.eval_text(s, metrics.orderBy("sample_id").collect())
    with pytest.raises(Exception):
        scout.evaluate_goldens(spark, str(tmp_path / "none"), runner)


def test_stream(spark, tmp_path):
    plant(tmp_path, {"in/r.json": json.dumps({"task": "t", "repo_root": "/r", "seed_files": ["internal/auth/handler.go"]})})
    stream_packs(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), table(spark, F1)).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).first().main_chain == ["internal/auth/handler.go"]


def test_cli(tmp_path):
    a = cli.parser().parse_args(["run", "--task", "t", "--repo", str(tmp_path), "--seed", "a", "--depth", "2"])
    r = cli.request_of(a)
    assert (r.depth, r.seed_files, r.repo_root) == (2, ["a"], str(tmp_path)) and cli.main(["version"]) == 0
    assert cli.request_of(cli.parser().parse_args(["run", "--task", "t"])).budget is None


# --- the queries against SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_hot_base_name(spark):
    """A name that very many directories have: an exact path still resolves to one file."""
    many = [(f"d{i}/index.ts", "import { a } from './util';") for i in range(2000)] + [(f"d{i}/util.ts", "") for i in range(2000)]
    edges = graph.import_edges(spark.createDataFrame(many, "path string, content string"))
    assert edges.count() == 2000
    assert edges.where("substring_index(src, '/', 1) <> substring_index(dst, '/', 1)").isEmpty()


def test_lines_cut_inside_a_character(spark):
    from pyspark.sql import functions as F

    from trailhead.functions import extract

    row = spark.createDataFrame([("a\u00e9\nb",)], "t string").select(extract.lines(F.col("t"), 2).alias("x"), extract.lines(F.col("t"), 3).alias("y")).first()
    assert row.x == ["a\ufffd"] and row.y == ["a\u00e9"]


def test_flags_with_commas():
    from trailhead import cli

    a = cli.parser().parse_args(["run", "-t", "x", "-s", "a.go, b.go", "-s", "c.go", "--no-color", "-q"])
    assert cli.request_of(a).seed_files == ["a.go", "b.go", "c.go"] and a.color is False and a.quiet
