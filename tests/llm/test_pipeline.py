"""The pipeline's stages against brute-force versions of what they keep."""

from collections import defaultdict

import numpy as np
import test_ops as ops

import corpus_pipeline
from trailhead.llm import quality

SF = "/root/testdata/sf0.001"


def test_stage_edges(spark):
    """Null ids and texts, empty, very long and repeated texts, clashing columns, an empty table."""
    line = "a line of well over forty characters that repeats everywhere"
    texts = [(1, None), (2, ""), (None, "no id at all"), (4, "word " * 60_000), (5, "same text here, of some words"), (5, "same text here, of some words"), (6, "same text here, of some words")]
    texts += [(10 + i, f"{line}\n{i} own words {i} of text {i} number {i}") for i in range(6)]
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, rep string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        assert stage(spark, docs.where("false"), SF).count() == 0
        if name != "packing":
            assert got.columns == docs.columns
        kept[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in got.select("doc_id").collect())
    ids = sorted(-1 if i is None else i for i, _ in texts)
    assert set(kept["quality"]) <= set(ids)
    assert kept["line_dedup"] == ids and kept["decontaminate"] == ids and set(kept["packing"]) == set(ids)
    assert kept["near_join"] == [i for i in ids if i != 6]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_join", "decontaminate", "packing"]
    stage = dict(corpus_pipeline.STAGES)

    model = quality.fitted(spark, SF)
    every = docs.collect()
    kept = [r for r, s in zip(every, model.score([r.text for r in every])) if s >= quality.THRESHOLD]
    one = stage["quality"](spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS
    assert ops.rows(one, "doc_id", "text") == sorted((r.doc_id, r.text) for r in kept)

    two = stage["line_dedup"](spark, one, SF)
    lines = [(i, t) for i, _, _, t in ops.brute_lines([(r.doc_id, r.text) for r in kept])]
    assert ops.rows(two, "doc_id", "text", "n_chars") == [(i, t, len(t)) for i, t in lines]

    three = stage["near_join"](spark, two, SF)
    firsts = {i for i, _, c in ops.brute_near(lines) if i == c}
    assert three.columns == corpus_pipeline.COLUMNS
    assert [i for i, _ in ops.rows(three, "doc_id", "text")] == sorted(firsts)

    four = stage["decontaminate"](spark, three, SF)
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in (split(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()) if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    text = dict(lines)
    left = sorted(i for i in firsts if clean(split(text[i])))
    assert [i for i, _ in ops.rows(four, "doc_id", "text")] == left

    five = stage["packing"](spark, four, SF).collect()
    got = defaultdict(list)
    for r in five:
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4")))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(ops.packing.vocabulary())
    assert sorted(got) == left
    for i in left:
        ids = np.concatenate([x for _, x in sorted(got[i], key=lambda p: p[0])]).tolist()
        assert ids == tok.encode(text[i], add_special_tokens=False).ids + [1]

    whole = corpus_pipeline.run(spark, SF)
    assert ops.rows(whole, "doc_id", "start", "ids_crc32") == sorted((r.doc_id, r.start, r.ids_crc32) for r in five)
