"""The small Arrow helpers."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from rillmark.functions import edits, records
from rillmark.operators import dedup
from rillmark.plans.catalogue import REGISTRY


def test_json_leaves(spark):
    texts = [(1, '{"a": {"b": " x "}, "id": "no", "c": ["y", "X", 5, ""]}'), (2, "{bad"), (3, None), (4, "prose"), (5, "[" * 5000)]
    out = records.json_leaves(spark.createDataFrame(texts, "k long, t string"), "k", "t").orderBy("position").collect()
    assert [tuple(r) for r in out] == [(1, 0, "a.b", "x"), (1, 1, "c", "y")]


def test_edit_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", ""), (None, "x")], "a string, b string")
    assert [r["r"] for r in records.edit_similarity(df, "a", "b", "r").collect()] == [0.75, 1.0, None]


def test_pack_sections(spark):
    text = "intro one two\n\nHeading\na b c\nd e\nf g h i j k l\nOther\nz"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, t string")
    out = records.pack_sections(df, "k", "t", r"^[A-Z][a-z]+$", size=5).collect()
    assert [(r["heading"], r["chunk_text"]) for r in out] == [(None, "intro one two"), ("Heading", "a b c\nd e"), ("Heading", "f g h i j k l"), ("Other", "z")]


def _edited_questions() -> list[str]:
    """Short questions, each also with one character changed in several of its words."""
    rng = random.Random(9)
    words = ["who", "deferred", "the", "roof", "sheets", "tool", "chests", "sent", "to", "joramar", "when", "was", "grain", "store", "paid"]
    out = {"ab", "abc", "a", "abcdefgh", "abcdefghi"}
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(4, 9))]
        out.add(" ".join(base))
        for changed in range(1, 5):
            edited = list(base)
            for i in rng.sample(range(len(base)), min(changed, len(base))):
                at = rng.randrange(len(edited[i]))
                edited[i] = edited[i][:at] + rng.choice(["", "x", edited[i][at] * 2]) + edited[i][at + 1 :]
            out.add(" ".join(" ".join(edited).split()))
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.85, 0.88, 0.95])
def test_edit_candidates_hold_every_pair(spark, threshold):
    texts = _edited_questions()
    want = {(i, j) for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if SequenceMatcher(None, a, b, autojunk=False).ratio() >= threshold}
    pairs = dedup.edit_candidates(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", threshold)
    got = {(r["a"], r["b"]) for r in records.edit_similarity(pairs, "ta", "tb", "r").where(f"r >= {threshold}").collect()}
    assert len(want) > 20 and got == want


def test_edit_similar_questions_with_few_words_in_common(spark, tmp_path):
    asked = [("q1", "who deferred the roof sheets sent to joramar"), ("q2", "who defered the roof sheetz sent to joranmar"), ("q3", "when was the grain store paid")]
    spark.createDataFrame(asked, "query_id string, query_text string").write.parquet(f"{tmp_path}/retrieval_runs.parquet")
    out = REGISTRY.queries["c32_edit_similar_questions"](spark, str(tmp_path)).collect()
    assert [(r["a"], r["b"]) for r in out] == [("q1", "q2")]


def _rows_shuffled(spark) -> int:
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_edit_similar_questions_of_shared_wording_are_no_rows_before_they_are_judged(spark, tmp_path):
    rng = random.Random(4)
    tools, months = ["roof sheets", "solar pumps", "fishing nets"], ["january", "february", "march", "april"]
    place = lambda: "".join(rng.choice(["ra", "mi", "to", "ku", "ne", "sol", "var", "pet"]) for _ in range(5))
    asked = sorted({f"who deferred the {rng.choice(tools)} that were sent in {rng.choice(months)} to {place()}" for _ in range(1200)})
    spark.createDataFrame([(f"q{i:04}", t) for i, t in enumerate(asked)], "query_id string, query_text string").write.parquet(f"{tmp_path}/retrieval_runs.parquet")
    before = _rows_shuffled(spark)
    got = {(r["a"], r["b"]): r["ratio"] for r in REGISTRY.queries["c32_edit_similar_questions"](spark, str(tmp_path)).collect()}
    assert _rows_shuffled(spark) - before < 40 * len(asked)  # each text goes to the pairs of its block with 24 at most
    every = [(i, j) for j in range(len(asked)) for i in range(j)]
    for i, j in rng.sample(every, 3000):
        ratio = SequenceMatcher(None, asked[i], asked[j], autojunk=False).ratio()
        assert got.get((f"q{i:04}", f"q{j:04}")) == (round(ratio, 6) if ratio >= 0.88 else None)
    assert len(got) > 10_000


@pytest.mark.parametrize(("threshold", "block"), [(0.6, 700), (0.88, 2_000), (0.88, 1 << 20)])
def test_edit_pairs_equal_brute_force_in_blocks_of_any_size(spark, threshold, block):
    texts = [*_edited_questions(), "who défèred thé roof", "who deferred thé roof", "\U0001f33e grain store paid", "\U0001f33e grain store, paid", "x" * 300 + "y" * 40, "x" * 290 + "y" * 55, "", None]
    ratios = {(i, j): SequenceMatcher(None, a, b, autojunk=False).ratio() for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if a and b}
    out = dedup.edit_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", threshold, block_characters=block).collect()
    assert len(out) == len({(r["a"], r["b"]) for r in out})
    assert {(r["a"], r["b"]): r["ratio"] for r in out} == {p: r for p, r in ratios.items() if r >= threshold}


def test_near_texts_in_small_tiles(monkeypatch):
    texts = _edited_questions()
    side = np.arange(len(texts)) % 2
    for name, value in (("ROWS", 7), ("COLUMNS", 11), ("PAIRS", 13), ("PLANES", 20), ("CELLS", 3_000), ("MOST_CELLS", 1_500)):
        monkeypatch.setattr(edits, name, value)
    parts = list(edits.near_texts(np.arange(len(texts)), texts, side, 0.88))
    want = {(i, j): SequenceMatcher(None, a, b, autojunk=False).ratio() for j, b in enumerate(texts) for i, a in enumerate(texts[:j]) if side[i] != side[j]}
    assert len(parts) > 1 and {(r.a, r.b): r.ratio for p in parts for r in p.itertuples()} == {p: r for p, r in want.items() if r >= 0.88}


def test_matched_characters_equal_the_sequence_matcher():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(60)]
    codes, at, size = edits.character_numbers(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    want = [sum(b.size for b in SequenceMatcher(None, texts[x], texts[y], autojunk=False).get_matching_blocks()) for x, y in zip(i, j)]
    assert edits.matched_characters(codes, at[i], size[i], at[j], size[j]).tolist() == want
