"""Brute force and edge cases for top items, splitting, splits, formatting duplicates and mixtures."""

import json
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import format_duplicates, grouped_splits, mixing, splitting, top_items


def test_top_n_matches_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    data = []
    for i in range(6000):
        g = "hot" if rng.random() < 0.5 else rng.choice("abcdef")
        score = rng.choice([None, float("nan"), -0.0, 0.0, 1.0, 2.0, 2.0, rng.random()])
        data.append((g if rng.random() > 0.01 else None, rng.choice(["r", "s"]), rng.randint(1, 40), f"c{rng.randint(1, 60):02d}" if rng.random() > 0.01 else None, score, i, "x", "y"))
    df = spark.createDataFrame(data, "q string, retriever string, run long, chunk string, score double, low long, t0 string, Rank string").repartition(7)
    best = {}
    for q, r, run, chunk, s, *_ in data:
        if s is not None and s == s:
            k = (q, r, chunk, run)
            best[k] = max(best.get(k, -1e9), s)
    want = set()
    groups = {}
    for (q, r, c, run), s in best.items():
        groups.setdefault((q, r), []).append((-s, c or "", run, c))
    for (q, r), items in groups.items():
        want |= {(q, r, run, c) for _, _, run, c in sorted(items, key=lambda x: x[:3])[:10]}
    for held in (top_items.HELD_ROWS, 50):
        monkeypatch.setattr(top_items, "HELD_ROWS", held)
        out = top_items.top_n_per_group(df, ["q", "retriever"], "score", ["chunk", "run"], 10)
        assert {(x["q"], x["retriever"], x["run"], x["chunk"]) for x in out.collect()} == want
    assert top_items.top_n_per_group(df.limit(0), ["q"], "score", ["chunk"], 3).count() == 0


def test_every_group_has_a_bound(spark):
    """100,000 groups of 20 rows and one of a million in 16 partitions: the rows left are near the result, the null group included."""
    big = spark.range(0, 1_000_000, 1, 16).select(F.lit(None).cast("long").alias("g"), F.rand(1).alias("s"), "id")
    small = spark.range(0, 2_000_000, 1, 16).select((F.col("id") % 100_000).alias("g"), F.rand(2).alias("s"), (F.col("id") + 2**60).alias("id"))
    df = big.union(small).coalesce(16)
    left = top_items.bounded_items(df, ["g"], "s", ["id"], 3)
    rows = {r["hot"]: r["n"] for r in left.groupBy(F.isnull("key.g0").alias("hot")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows[True] <= 3 * 16 and rows[False] < 2_000_000
    out = top_items.top_n_per_group(df, ["g"], "s", ["id"], 3)
    assert out.count() == 300_003
    best = big.orderBy(F.desc("s"), "id").limit(3)
    assert {r["id"] for r in out.where("g is null").collect()} == {r["id"] for r in best.collect()}


def _check_pieces(text, pieces, limit, overlap):
    words = text.split()
    assert all(len(p["piece_text"].split()) == p["piece_words"] <= limit for p in pieces)
    at = 0
    for i, p in enumerate(pieces):
        start = 0 if i == 0 else at - overlap
        assert p["start_word"] == start and p["piece_text"].split() == words[start : start + p["piece_words"]]
        at = start + p["piece_words"]
    assert at == len(words)


def test_split_oversized(spark):
    rng = random.Random(2)
    texts = {
        1: " ".join(f"w{i}" for i in range(301)),
        2: "\n\n".join(" ".join(f"w{i}" + ("." if rng.random() < 0.1 else "") for i in range(rng.randint(40, 130))) for _ in range(14)),
        3: "short text", 4: "", 5: None, 6: "  \n " + "x " * 700, 7: "y" * 5000, 8: " ".join(["word"] * 20000), 9: "Rs. 5 paid. " * 400, 10: " ".join(["w"] * 300),
    }
    df = spark.createDataFrame([(k, t, 1000, 7, "a", "b") for k, t in texts.items()], "k long, text string, start_word int, previous_overlap int, piece_index string, __end string").drop("__end")
    out = splitting.split_oversized(df, "text", 300, 60)
    by = {}
    for r in out.orderBy("k", "piece_index_").collect():
        by.setdefault(r["k"], []).append({"piece_text": r["piece_text"], "piece_words": r["piece_words"], "start_word": r["start_word_"], "overlap": r["previous_overlap_"]})
    assert sorted(by) == [1, 2, 6, 8, 9]
    for k, pieces in by.items():
        _check_pieces(texts[k], pieces, 300, 60)
        assert [p["overlap"] for p in pieces] == [0] + [60] * (len(pieces) - 1)
    # cuts fall on natural boundaries where there are any
    assert all(re.search(r"\.$", p["piece_text"]) for p in by[9][:-1])
    own = splitting.split_oversized(df.drop("piece_index"), "text", 300, 60, start_col="start_word", overlap_col="previous_overlap").where("k = 1").orderBy("piece_index").collect()
    assert [(r["start_word"], r["previous_overlap"]) for r in own] == [(1000, 7), (1000 + own[0]["piece_words"] - 60, 60)]
    assert splitting.split_oversized(df.limit(0), "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "text", 100, 90)


def test_split_by_characters(spark):
    text = "Line one here.\n\n" * 40 + "z" * 900
    out = splitting.split_oversized(spark.createDataFrame([(1, text)], "k long, text string"), "text", 200, 20, by="characters").orderBy("piece_index").collect()
    joined = out[0]["piece_text"] + "".join(r["piece_text"][20:] for r in out[1:])
    assert joined == text and max(len(r["piece_text"]) for r in out) <= 200
    assert out[0]["piece_text"].endswith("\n\n")


def test_scheme_components_and_splits(spark):
    filings = [("d1", "A"), (" D1\t", "b"), ("d2", " B "), ("d2", "c"), ("d3", "x"), ("d4", None), (None, "y"), ("d5", ""), ("d6", "z"), ("d6", "x")]
    docs = spark.createDataFrame([(*f, "t") for f in filings], "document_id string, scheme_id string, component string")
    schemes, items = grouped_splits.scheme_components(docs, "document_id", "scheme_id")
    comp = dict(schemes.collect())
    assert comp["a"] == comp["b"] == comp["c"] and comp["x"] == comp["z"] and len(set(comp.values())) == 2
    chunks = [(i, d) for i, d in enumerate(["d1", "D2", "d3", "d6", "d4", None, "nowhere", "Nowhere ", "", "d5"] * 30)]
    chunks_df = spark.createDataFrame([(*c, 1) for c in chunks], "chunk_row long, document_id string, key int")
    out = grouped_splits.grouped_splits(chunks_df, "chunk_row", "document_id", docs, "document_id", "scheme_id", {"train": 0.8, "test": 0.2}, bins=10)
    got = {r["key"]: (r["component"], r["split_name"]) for r in out.collect()}
    assert len(got) == len(chunks)
    by = {}
    for c, s in got.values():
        by.setdefault(c, set()).add(s)
    assert all(len(s) == 1 for s in by.values())
    assert got[0] == got[1] and got[2] == got[3] and got[6] == got[7] and got[5][0] != got[15][0]
    empty = grouped_splits.grouped_splits(chunks_df.limit(0), "chunk_row", "document_id", docs.limit(0), "document_id", "scheme_id", {"train": 1.0})
    assert empty.count() == 0
    assert [r["records"] for r in grouped_splits.split_shares(empty, {"train": 1.0}).collect()] == [0]


@pytest.mark.parametrize("most,slack", [(100, 1.4), (4096, 1.05)])
def test_bins_are_balanced(spark, monkeypatch, most, slack):
    """Over one task nearly equal; over many small tasks, each of which returns one partition, coarser."""
    rng = random.Random(4)
    weights = [(f"c{i}", rng.randint(1, 90)) for i in range(3000)] + [("none", None), ("zero", 0)]
    monkeypatch.setattr(grouped_splits, "TASK_TUPLES", most)
    out = grouped_splits.balanced_bins(spark.createDataFrame(weights, "c string, w long"), "c", "w", 20).collect()
    assert sorted(r["c"] for r in out) == sorted(c for c, _ in weights)
    total = {}
    for r in out:
        total[r["bin"]] = total.get(r["bin"], 0) + r["w"]
    ideal = sum(w or 0 for _, w in weights) / 20
    assert len(total) == 20 and max(total.values()) <= slack * ideal


def _canonical(text):
    if text is None:
        return None
    bare = lambda s: "".join(c for c in s.lower() if unicodedata.category(c)[0] in "LN")
    if not bare(text):
        return None
    try:
        obj = json.loads(text)
    except ValueError:
        obj = None
    if isinstance(obj, dict):
        value = lambda v: "".join(map(value, v)) if isinstance(v, list) else str(v)
        return ("r", *sorted(bare(k + value(v)) for k, v in obj.items()))
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) >= 2 and all(re.match(r"\s*[A-Za-z][A-Za-z _]{0,39}:\s*\S", x) for x in lines):
        return ("r", *sorted(map(bare, lines)))
    return ("p", bare(text))


def test_format_duplicates_match_brute_force(spark):
    texts = [
        "Hello, World", "hello   world!", "HELLO-WORLD", "hello worlds", '{"Title": "A b", "List": ["x", "y"], "N": 5}', '{"n": 5, "list": ["x","y"], "title": "a  B"}', "List: x; y\nTitle: a b\nN: 5",
        '{"List": ["y", "x"], "Title": "A b", "N": 5}', "Title: a\nnot a field", "title a not a field", "", None, "...", "...", "नमस्ते दुनिया", "नमस्ते, दुनिया!", "{bad json}", "bad json", '["a"]', "a", "x: y", "x y", "Hello, World",
        "a: b\nc: d", "c: d\n\n a: b", "a: b\na: b", "a: b",
    ]
    rows = [(i + 1, t, "z", "z") for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "id long, text string, canonical_text string, copies string")
    groups, members = format_duplicates.collapse_formatting(df, "id", "text")
    want = {}
    for i, t, *_ in rows:
        if _canonical(t) is not None:
            want.setdefault(_canonical(t), []).append(i)
    assert {r["key"]: r["group_key"] for r in members.collect()} == {i: min(g) for g in want.values() for i in g}
    assert {r["group_key"]: r["copies"] for r in groups.collect()} == {min(g): len(g) for g in want.values()}
    kept = format_duplicates.collapsed_records(df, "id", "text")
    assert kept.count() == len(want) and "copies_" in kept.columns
    g, m = format_duplicates.collapse_formatting(df.limit(0), "id", "text")
    assert g.count() == 0 and m.count() == 0


def test_fit_lengths_reaches_what_is_reachable():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 7), replace=False))
        counts = rng.integers(1, 6, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 20))
        take = mixing.fit_lengths(lengths, counts, budget)
        used = int((lengths * take).sum())
        assert (take >= 0).all() and (take <= counts).all() and used <= max(budget, 0)
        if budget >= total:
            assert used == total
    take = mixing.fit_lengths(np.array([3, 5, 1000]), np.array([10**6, 10**6, 10**6]), 123_456_789)
    assert (np.array([3, 5, 1000]) * take).sum() == 123_456_789


def test_mixture(spark):
    texts = [(i, s, "word " * n) for i, (s, n) in enumerate([("A ", 5), ("a", 7), ("a", 3), ("b", 4), ("B", 2), (None, 9), ("unlisted", 5)] * 8)] + [(900, "a", None), (901, "a", "")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, source string, text string, tokens int")
    counted = mixing.count_tokens(docs, "doc_id", "source", "text").cache()
    assert {r["tokens"] for r in counted.where("doc_key >= 900").collect()} == {0}
    targets = spark.createDataFrame([("a", 0.25, 1), ("b", 0.25, 3), ("gone", 0.5, 2)], "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix_sources(counted, targets)
    rows = mixture.collect()
    cap = {"a": 1, "b": 3}
    assert rows and all(1 <= r["repeats"] <= cap[r["source"]] for r in rows) and len({r["doc_key"] for r in rows}) == len(rows)
    got = {r["source"]: r for r in shares.collect()}
    for s in cap:
        assert got[s]["tokens"] == sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s)
        assert got[s]["actual_share"] == pytest.approx(0.5, abs=0.02)
    assert got["gone"]["tokens"] == 0
    again, _ = mixing.mix_sources(counted, targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    small, _ = mixing.mix_sources(counted, targets, total_tokens=40)
    assert sum(r["tokens"] * r["repeats"] for r in small.collect()) <= 40
    none, report = mixing.mix_sources(counted.limit(0), targets)
    assert none.count() == 0 and report.where("tokens > 0").count() == 0
