"""Each operator against a brute-force version, an exact round trip or SQL, with the edge cases of its docstring."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailhead.llm import (
    chat_format, components, decontaminate, embedding_dedup, lang_id, line_dedup, near_join, packing, quality, registry,
    suffix_dedup, url_filter,
)

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(map(repr, rows(df, *cols))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


# --- line dedup


def brute_lines(docs, min_chars=40, min_docs=5):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < min_docs or max(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(docs_of):
    common = "The same LINE in many documents, long enough to count"
    accents = "É" * 39 + "x"
    docs = [(i, f"own {i}\n  {common.upper() if i % 2 else common}\t\nend\n{accents}\n") for i in range(7)]
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, f"{common}\n{common}"), (54, "short\n" * 9), (53, f"{common}\n{common}")]
    df = docs_of(docs).withColumn("n_dropped", F.lit("clash")).withColumn("key", F.lit(1))
    got = line_dedup.dedup_lines(df)
    assert rows(got, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(docs)
    assert {"key", "source"} <= set(got.columns)
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


# --- language ID


def test_line_dedup_edges(docs_of):
    line = "a line of more than forty characters, for the test"
    docs = docs_of([(i, f"{line}\nown {i}") for i in range(6)] + [(None, line), (3, f"{line}\nown 3"), (9, None)])
    odd = docs.withColumns({c: F.lit(1) for c in ("__drop", "__out", "__key", "n_lines", "n_dropped")})
    got = line_dedup.dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "__out", "n_lines", "n_dropped"]
    want = sorted([(i, f"own {i}", 2, 1) for i in (0, 1, 2, 3, 3, 4)] + [(5, f"{line}\nown 5", 2, 0), (-1, line, 1, 0), (9, "", 1, 0)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert line_dedup.dedup_lines(odd.where("false")).count() == 0


def test_lang_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang_id.op2_lang_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "the and of the with " * 100_000), (5, "the")], "doc_id long, text string")
    model = lang_id.train(docs)
    named = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(odd, model).collect()}
    assert [named[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert named[4][0] == "en" and 0 <= named[5][1] <= 1
    nothing = lang_id.train(docs.where("false"))
    assert {r.lang_pred for r in lang_id.identify(odd, nothing).collect()} == {"und"}


def test_lang_brute(spark):
    """The same model with dictionaries and code points one at a time; clashing names, repeated rows, no rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    known = docs.where(~lang_id.common.held_out(F.col("doc_id")))
    model = lang_id.train(known)
    orders, bits = (1, 2, 3), 15

    def bucket(gram):
        h = 0x9E37 + len(gram)
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return h >> 32 - bits

    def grams(text):
        text = f" {text.lower()} "
        return [bucket(text[i : i + n]) for n in orders for i in range(len(text) - n + 1)]

    count, rows_of = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in known.where("lang is not null and text is not null").collect():
        rows_of[r.lang] += 1
        for b in grams(r.text):
            count[r.lang][b] += 1
    total = {x: sum(count[x].values()) + 0.5 * (1 << bits) for x in count}

    def score(text):
        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            return "und", 0.0
        found = grams(text)
        at = {x: np.log(rows_of[x] / sum(rows_of.values())) + sum(np.log((count[x][b] + 0.5) / total[x]) for b in found) for x in sorted(count)}
        best = max(at, key=lambda x: (at[x], [-ord(c) for c in x]))
        return best, 1 / sum(np.exp(v - at[best]) for v in at.values())

    texts = [r.text for r in docs.limit(25).collect()] + ["½ ²", "Ⅷ ʰ", "é", "漢", "the", "the", None, ""]
    odd = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, lang_pred string")
    got = lang_id.identify(odd, model, keep=("doc_id", "score", "lang_pred"))
    assert got.columns == ["doc_id", "lang_pred", "score"]
    for r in got.collect():
        lang, p = score(texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - p) < 1e-9
    assert lang_id.identify(odd.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        lang_id.train(known, max_langs=1)


def test_lang_features_in_parts():
    text = "abcdefghij" * 30
    whole = [(n.tolist(),) for _, _, n in lang_id.chunks([text], (1, 2, 3), 12)]
    parts = [n for _, _, n in lang_id.chunks([text], (1, 2, 3), 12, most=50)]
    assert sorted(x for w in whole for x in w[0]) == sorted(np.concatenate(parts).tolist())


# --- suffix dedup


def brute_suffix(docs, length=100):
    first, out = set(), []
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in first:
                gone[p : p + length] = True
            first.add(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        out.append((i, len(b), int(gone.sum()), int((edge == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def suffix_case(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(30)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [say(40) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = [say(r.randint(1, 30))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(60, 250)], say(r.randint(1, 20))]
        docs.append((i * 3, " ".join(parts)))
    return docs


def test_suffix_dedup(docs_of):
    docs = suffix_case(1)
    docs += [(500, None), (501, ""), (502, "x" * 99), (503, "x" * 100), (504, "x" * 450), (505, "ab" * 300), (506, docs[3][1]), (507, docs[3][1] + "!")]
    docs += [(600 + k, "shared anchor string of 24b" + chr(97 + k) * 120) for k in range(6)]
    got = suffix_dedup.dedup_substrings(docs_of(docs).withColumn("doc", F.lit(1)))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect())
    assert got == brute_suffix(docs)
    twice = suffix_dedup.dedup_substrings(docs_of([(1, "z" * 150 + "y" * 150)] * 2)).collect()
    assert len(twice) == 2 and {(r.n_removed, r.n_spans) for r in twice} == {(298, 2)}
    assert suffix_dedup.dedup_substrings(docs_of([])).count() == 0


def test_suffix_parts_and_blocks(docs_of, monkeypatch):
    """Small chunks cut long texts into parts; small blocks send large buckets place by place."""
    docs = suffix_case(2, 25)
    docs.append((999, " ".join(t for _, t in docs) + docs[4][1]))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    found = [x for x in suffix_dedup._runs(1, 100)(iter([_batch(docs)]))]
    table = [r for b in found for r in b.to_pylist()]
    import pyarrow as pa

    told = suffix_dedup._settle(100)(pa.Table.from_pylist(table)).to_pylist()
    asks = defaultdict(list)
    gone = defaultdict(list)
    for r in told:
        (gone if r["kind"] == 0 else asks)[r["doc"]].append(r["block"])
    text = {i: t.encode() for i, t in docs}
    batch = pa.RecordBatch.from_pydict({"__doc": list(asks), "__text": [text[i] for i in asks], "__asks": [asks[i] for i in asks]})
    parts = [r for b in suffix_dedup._cut(1, 100)(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(suffix_dedup.repeats, "__defaults__", (100, 64))
    for r in suffix_dedup._compare(100)(pa.Table.from_pylist(parts)).to_pylist():
        gone[r["doc"]].append(r["block"])
    batch = pa.RecordBatch.from_pydict({"__doc": list(text), "__text": list(text.values()), "__gone": [gone.get(i) for i in text]})
    got = [(r["doc"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for b in suffix_dedup._remove(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == brute_suffix(docs)


def _batch(docs):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"__doc": [i for i, _ in docs], "__text": [t.encode() for _, t in docs]})


def test_difference_cover():
    for v in (8, 16, 32):
        d = suffix_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


# --- near duplicates


def brute_near(docs):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def near_case(seed, groups=12, copies=9):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(groups):
        base = [word() for _ in range(r.choice([1, 4, 5, 7, 12, 40, 90, 300, 1200]))]
        if g % 3 == 0:
            base += passage
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(base) // 40])):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.2:
                own = own[: max(1, len(own) - len(own) // 12)]
            docs.append((r.randrange(10**6), " ".join(own)))
    return list(dict(docs).items())


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups(docs_of, seed):
    docs = near_case(seed)
    docs += [(-5, None), (-4, ""), (-3, " \t\n"), (-2, "one two"), (-1, "ONE  two\n")]
    df = docs_of(docs).withColumn("cid", F.lit(3))
    assert rows(near_join.near_groups(df), "doc_id", "n_shingles", "component_id") == brute_near(docs)


def test_near_groups_other_ways(docs_of, monkeypatch):
    """No popular list, all keys per hash (as when a sketch is weak), and a chain that only a second round can join."""
    docs = near_case(3, groups=8, copies=6)
    want = brute_near(docs)
    assert rows(near_join.near_groups(docs_of(docs), popular_keys=8), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(near_join, "weak_bands", lambda found: frozenset(range(31)))
    assert rows(near_join.near_groups(docs_of(docs)), "doc_id", "n_shingles", "component_id") == want
    monkeypatch.setattr(near_join, "PART", 3)
    assert rows(near_join.near_groups(docs_of(docs)), "doc_id", "n_shingles", "component_id") == want
    assert near_join.near_groups(docs_of([])).count() == 0
    assert rows(near_join.near_groups(docs_of([(1, "a b"), (1, "a b")])), "doc_id", "component_id") == [(1, 1)]
    odd = docs_of([(None, "a b"), (1, "a b"), (1, "c d"), (2, "a b"), (3, "c d")])
    assert rows(near_join.near_groups(odd), "doc_id", "component_id") in ([(1, 1), (2, 1), (3, 3)], [(1, 1), (2, 2), (3, 1)])


def test_near_sets_lie_in_one_file_a_bucket(docs_of, monkeypatch):
    """What a task writes of the table of sets is one bucket: its exchange is by the id alone."""
    kept, real = [], near_join.common.store

    def store(df, *args, by=None, **more):
        out = real(df, *args, by=by, **more)
        if by:
            kept.append(out)
        return out

    monkeypatch.setattr(near_join.common, "store", store)
    df = docs_of([(i, " ".join(f"w{i}.{j}" for j in range(30))) for i in range(400)])
    assert near_join.near_groups(df).count() == 400
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert len(kept) == 1 and len(kept[0].inputFiles()) <= 2 * buckets  # rows of popular keys have no id, and a bucket of their own


def test_near_groups_hub_and_chain(docs_of):
    """A large group of copies that are near to one text only, and a chain whose neighbours alone are near."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    hub = []
    for i in range(150):
        own = list(base)
        for at in r.sample(range(0, 200, 12), 4):
            own[at] = f"x{i}.{at}"
        hub.append((2000 + i, " ".join(own)))
    line = [f"c{i}" for i in range(900)]
    chain = [(5000 + k, " ".join(line[8 * k : 8 * k + 120])) for k in range(90)]
    docs = [(2500, " ".join(base)), *hub, *chain]
    r.shuffle(docs)
    assert rows(near_join.near_groups(docs_of(docs)), "doc_id", "n_shingles", "component_id") == brute_near(docs)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 900), st.integers(0, 200), st.integers(0, 10**6))
def test_prefixes_meet(n, cut, seed):
    """Two sets that share enough have a key in common in every band that holds both; parities bound the distance."""
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
    k = cut % (len(a) // 9 + 1)
    b = np.unique(np.concatenate([a[k:], r.integers(0, 2**63, k, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both < 80 * (len(a) + len(b) - both):
        return
    band = [x for x in near_join.bands(len(a)) if x in near_join.bands(len(b))]
    assert band
    for x in band:
        first = [np.sort(near_join.keys(s, *x))[: near_join.needed(len(s))] for s in (a, b)]
        assert np.intersect1d(*first).size or near_join.weak(a, *x) or near_join.weak(b, *x)
        p, q = (np.frombuffer(near_join.bits(s, x[1]), np.uint8) for s in (a, b))
        assert np.bitwise_count(p ^ q).sum() <= len(np.setxor1d(a, b))
        if 0 < x[0] < 4:
            wide = np.frombuffer(near_join.bits(a, 4 * x[1]), np.uint8)
            assert near_join.fold(wide, 4).tolist() == p.tolist()


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(2000, 2100)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    linked = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame([*links, (None, 1)], "a long, b long")
    assert rows(components.components(df), "node", "root") == sorted((x, find(x)) for x in linked)
    assert components.components(df.where("false")).count() == 0


# --- chat formatting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<s>"]), st.text(alphabet="a\\<>s/[]INST \n　é😀", max_size=30)), max_size=5))
def test_chat_round_trip(turns):
    text, spans = chat_format.render(turns)
    assert chat_format.parse(text) == turns
    import public_tokenizers

    tok = chat_format._tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    ids, off, mask = chat_format.align(text, spans, tok)
    assert tok.decode(ids.tolist(), skip_special_tokens=False) == text
    covered = {c for (a, b), on in zip(off, mask) if on for c in range(a, b)}
    assert covered == {c for a, b, on in spans if on for c in range(a, b)}


def test_chat_edges(spark):
    data = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (2, None, None, "x"), (None, 0, "assistant", "yo")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(0))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 0 and got[2].n_turns == 1
    assert got[None].loss_sha256 == hashlib.sha256(b"yo").hexdigest()
    assert chat_format.read_back(chat_format.format_chats(df.where("false"))).count() == 0


# --- quality


def test_quality(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op6_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93
    model = quality.fitted(spark, sf)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 400_000)], "doc_id long, text string")
    scored = {r.doc_id: r.score for r in quality.score_quality(odd, model).collect()}
    assert scored[1] == scored[2] and all(0 <= s <= 1 for s in scored.values())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert quality.train(docs, labels.where("false")) == 0.5
    assert quality.train(docs, labels.where("quality = 1")) == 1.0
    kept = quality.drop_rejected(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_mil_brute():
    """The forward pass passage by passage, and each gradient against differences of the loss."""
    r = np.random.default_rng(2)
    model = quality.Mil(hidden=3, gate=2)
    model.start(quality.WIDTH)
    texts = ["abc " * 300, "ab", "", "x y z " * 700]
    for text, got in zip(texts, model.score(texts)):
        p = model.par
        hs, es = [], []
        for _, x in quality.passages([text]):
            for row in x:
                h = np.tanh(row @ p["W"] + p["b"])
                hs.append(h)
                es.append(float((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        a = np.exp(np.array(es) - max(es))
        z = (a / a.sum()) @ np.array(hs)
        assert abs(1 / (1 + np.exp(-(z @ p["c"] + p["d"][0]))) - got) < 1e-5

    bags = [r.standard_normal((n, 5)) for n in (1, 2, 4)]
    y = np.array([1, 0, 1])

    def loss(par):
        out = 0.0
        for x, t in zip(bags, y):
            h = np.tanh(x @ par["W"] + par["b"])
            e = (np.tanh(h @ par["V"]) / (1 + np.exp(-(h @ par["U"])))) @ par["w"]
            a = np.exp(e - e.max())
            q = 1 / (1 + np.exp(-((a / a.sum()) @ h @ par["c"] + par["d"][0])))
            out -= t * np.log(q) + (1 - t) * np.log(1 - q)
        return out / len(bags)

    start = quality.Mil(hidden=3, gate=2)
    start.start(5)
    before = {k: v.astype(float).copy() for k, v in start.par.items()}
    after = quality.Mil(hidden=3, gate=2)
    after.fit(bags, y, epochs=1, batch=3, rate=1e-3, decay=0.0)
    for k, v in before.items():  # the first step of Adam is the rate against the gradient's sign
        for at in np.ndindex(v.shape):
            up, down = ({n: a.copy() for n, a in before.items()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            g = (loss(up) - loss(down)) / 2e-5
            if abs(g) > 1e-3:
                assert abs(after.par[k][at] - v[at] + 1e-3 * np.sign(g)) < 2e-5, (k, at, g)


def test_quality_edges(spark):
    model = quality.Mil()
    model.start(quality.WIDTH)
    odd = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (None, None, 5)], "doc_id long, text string, score int")
    got = quality.score_quality(odd, model, keep=("doc_id", "score", "text"))
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 3
    assert got.where("doc_id = 1").select("score").distinct().count() == 1
    assert quality.score_quality(odd.where("false"), model).count() == 0
    assert quality.drop_rejected(odd.where("false"), model).count() == 0


def test_mil_long_text_in_parts():
    model = quality.Mil()
    model.start(quality.WIDTH)
    text = "".join(random.Random(1).choice("abc de") for _ in range(quality.PASSAGE * 600))
    one = model.score([text, "ab", None])
    alone = [model.score([t])[0] for t in (text, "ab", None)]
    assert np.allclose(one, alone)


# --- decontamination


def test_decontaminate(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(25))
    bench = spark.createDataFrame(
        [("10", item), ("2", "Tiny item"), ("3", None), (None, item), ("4", "!!!"), ("10", item), ("x", " ".join(f"w{i}" for i in range(10)))],
        "item_id string, text string",
    )
    docs = [
        (1, "a b " + item.upper().replace(" ", ", ") + " c"), (2, "w0 w1 w2 w3 w4 w5 w6 w7 w8 no"), (3, "see tiny-ITEM here"),
        (4, None), (5, ""), (6, "..."), (7, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (1, "other"), (7, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),
    ]
    df = docs_of(docs).withColumn("n_hit", F.lit("clash"))
    got = decontaminate.contamination(df, bench)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == [
        (1, 1, 0, []), (1, 28, 25, ["10", "x"]), (2, 10, 0, []), (3, 4, 2, ["2"]), (4, 0, 0, []), (5, 0, 0, []), (6, 0, 0, []), (7, 10, 10, ["10"]),
    ]
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5, 6]
    assert decontaminate.contamination(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination(df.where("false"), bench).count() == 0


# --- packing


def test_packing(spark, docs_of):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = list(enumerate(texts)) + [(900, None), (901, ""), (902, "a <|endoftext|> b　漢字"), (903, "word " * 9000), (903, "again")]
    got = packing.pack_documents(docs_of(docs).repartition(3), block_tokens=9000).collect()
    tok = Tokenizer.from_file(packing.vocabulary())
    want = sorted((i, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_doc[r.doc_id, r.doc_tokens].append((r.start, ids))
        by_seq[r.sequence_id].append((r.offset, r.length, r.padded_to))
    back = sorted((d, [x for _, ids in sorted(p) for x in ids]) for (d, _), p in by_doc.items())
    assert back == want
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and len({p for _, _, p in pieces}) == 1
        padding += 2048 - at
    assert padding <= 3 * 2048


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_fill(sizes):
    got = packing.fill(sizes, 64)
    seq, doc = defaultdict(list), defaultdict(list)
    for i, start, n, s, offset in got:
        seq[s].append((offset, n))
        doc[i].append((start, n))
    assert len(seq) == -(-sum(sizes) // 64)
    for pieces in seq.values():
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *[n for _, n in sorted(pieces)][:-1]]).tolist()
        assert sum(n for _, n in pieces) <= 64
    for i, size in enumerate(sizes):
        assert [s for s, _ in sorted(doc[i])] == np.cumsum([0, *[n for _, n in sorted(doc[i])][:-1]]).tolist()
        assert sum(n for _, n in doc[i]) == size


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 120), max_size=40), st.sampled_from([1, 2, 7, 16, 40]))
def test_fill_brute(sizes, length):
    """The rule said plainly: dearest rest first, to the cheapest of all sequences with room, else cut to fill the roomiest."""
    rests = sorted(((n % length, -i) for i, n in enumerate(sizes) if n % length), reverse=True)
    whole = sum(n // length for n in sizes)
    room = [length] * -(-sum(n for n, _ in rests) // length)
    spent = [0.0] * len(room)
    want = []
    for n, i in rests:
        at = sizes[-i] - n
        while n:
            fits = [s for s in range(len(room)) if room[s] >= n] or [s for s in range(len(room)) if room[s] == max(room)]
            s = min(fits, key=lambda s: (spent[s], s))
            cut = min(n, room[s])
            want.append((-i, at, cut, whole + s, length - room[s]))
            room[s], spent[s] = room[s] - cut, spent[s] + packing.cost(cut, 1.0, 1 / 2048)
            at, n = at + cut, n - cut
    assert [x for x in packing.fill(sizes, length) if x[3] >= whole] == want


def test_packing_edges(docs_of):
    odd = docs_of([(None, "a b"), (1, None), (1, "x")]).withColumn("sequence_id", F.lit("clash"))
    got = packing.pack_documents(odd.coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.length == r.doc_tokens) for r in got) == [(0, True), (1, True), (1, True)]
    assert {round(r.sequence_cost, 9) for r in got} == {round(sum(packing.cost(r.length, 1.0, 1 / 2048) for r in got), 9)}
    assert packing.pack_documents(odd.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40) | st.text(alphabet="don't'ŝ 's \t\n é1²", max_size=40))
def test_encode_is_tokenizers(text):
    slow, _ = packing._encoders(packing.vocabulary())
    assert packing.encode(text, packing.vocabulary()) == slow.encode(text, add_special_tokens=False).ids


# --- embeddings


def brute_vectors(data, cosine=0.93):
    ok = [(i, l, np.array(v) / np.abs(v).max()) for i, v, l in data if l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for k, (i, l, v) in enumerate(ok):
        for j, m, w in ok[k + 1 :]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, _, _ in data:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 40])
def test_near_vectors(spark, block):
    r = np.random.default_rng(3)
    data = []
    for label in (0, 1, None):
        centres = r.standard_normal((25, 8))
        for k in range(150):
            v = centres[k % 25] + r.standard_normal(8) * r.choice([0.0, 0.1, 0.3])
            data.append((len(data), v.tolist(), label))
    data += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [None] + [1.0] * 7, 1), (905, [1e-200] * 8, 1), (906, [1e200] * 8, 1), (907, [1.0] * 3, 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = embedding_dedup.near_vectors(df, block=block)
    assert rows(got, "vec_id", "n_links", "component_id", "kept") == brute_vectors(data)
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_near_vectors_many_dimensions(spark):
    """64 dimensions: copies just above and just below the threshold, several labels, a label over a block and one without pivots."""
    r = np.random.default_rng(8)
    data = []
    for label, n in (("a", 30), ("b", 8), ("c", 3)):
        for _ in range(n):
            v = r.standard_normal(64)
            v /= np.linalg.norm(v)
            data.append((len(data), v.tolist(), label))
            for cosine in (0.93 + 1e-9, 0.93 - 1e-9, 0.95, 0.9, 1.0):
                w = r.standard_normal(64)
                w -= (w @ v) * v
                w /= np.linalg.norm(w)
                data.append((len(data), (cosine * v + np.sqrt(max(0, 1 - cosine**2)) * w).tolist(), label))
    data.append(data[5])
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    want = brute_vectors([x for i, x in enumerate(data) if i < len(data) - 1])
    got = rows(embedding_dedup.near_vectors(df, block=50, max_labels=1), "vec_id", "n_links", "component_id", "kept")
    assert sorted(set(got)) == want and len(got) == len(want) + 1
    assert sum(n > 0 for _, n, _, _ in want) > 100


def test_cover_tree_prunes_in_many_dimensions():
    """Points that are all far from each other become balls of one point, and bounds alone part them."""
    r = np.random.default_rng(9)
    x = r.standard_normal((1500, 64))
    x[750:] = x[:750] + 0.05 * r.standard_normal((750, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = np.sqrt(2 - 2 * 0.93)
    tree = embedding_dedup.cover_tree(x, np.arange(1500), 0, embedding_dedup._far(x, x[0]), reach / 4)
    assert tree.kids
    pairs, hits = 0, 0
    for p, q in embedding_dedup.dual(x, tree, tree, reach):
        pairs += len(p) * len(q)
        hit = x[p] @ x[q].T >= 0.93
        hits += int(np.triu(hit, 1).sum() if p is q else hit.sum())
    assert hits == np.triu(x @ x.T >= 0.93, 1).sum() == 750
    assert pairs < 10_000


def test_cover_tree_prunes_nothing_near():
    r = np.random.default_rng(5)
    x = np.concatenate([c + 0.05 * r.standard_normal((120, 6)) for c in r.standard_normal((20, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows_ = np.arange(len(x))
    tree = embedding_dedup.cover_tree(x, rows_, 0, embedding_dedup._far(x, x[0]), 0.05)
    seen = np.zeros((len(x), len(x)), dtype=bool)
    pairs = 0
    for p, q in embedding_dedup.dual(x, tree, tree, 0.37):
        seen[np.ix_(p, q)] = seen[np.ix_(q, p)] = True
        pairs += len(p) * len(q)
    assert (seen | (x @ x.T < 1 - 0.37**2 / 2)).all()
    assert pairs < len(x) ** 2 / 2


# --- URL filters


def test_url_filter(spark):
    import datetime as dt

    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    entries = spark.createDataFrame(
        [("spam", "B.com", "add", day(5)), ("spam", "b.com", "remove", day(9)), ("spam", "b.com", "add", day(20)), ("adult", "x.b.com", "add", day(0)),
         ("allow", "ok.b.com", "add", day(0)), ("spam", None, "add", day(1)), ("spam", "tie.com", "add", day(3)), ("spam", "tie.com", "remove", day(3))],
        "list string, key string, action string, at date",
    )
    captures = spark.createDataFrame(
        [(1, "http://a.b.com/x", day(4)), (2, "https://u@A.B.com:80/x", day(5)), (3, "http://b.com", day(9)), (4, "http://b.com", day(30)),
         (5, "http://x.b.com/", day(6)), (6, "http://ok.b.com/", day(6)), (7, None, day(6)), (8, "nonsense", day(6)), (9, "http://b.com", None),
         (10, "http://tie.com", day(4)), (4, "http://b.com", day(30))],
        "page_id long, url string, fetched date",
    ).withColumn("lists", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = url_filter.filter_urls(captures, entries)
    assert rows(got, "page_id", "lists", "blocked") == [
        (1, "", False), (2, "spam", True), (3, "", False), (4, "spam", True), (4, "spam", True), (5, "adult,spam", True), (6, "allow,spam", False),
        (7, "", False), (8, "", False), (9, "", False), (10, "", False),
    ]
    assert url_filter.filter_urls(captures.where("false"), entries).count() == 0
    assert url_filter.filter_urls(captures, entries.where("false")).where("blocked").count() == 0
