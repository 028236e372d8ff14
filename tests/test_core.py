"""Hand-computed cases and brute force for the core operators."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rillmark.functions import ranking, text
from rillmark.operators import chunking, dedup, entities, graph, metrics, retrieval, stats
from rillmark.operators.components import connected_components


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


def panel(spark, ranking_, gains):
    ranked = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ranking_)], "query_id string, chunk_id string, rank int")
    qrels = spark.createDataFrame([("q", c, g) for c, g in gains.items()], "query_id string, chunk_id string, relevance int")
    return metrics.metric_panel(ranked, qrels, ["query_id"]).first()


def test_metric_cases(spark):
    p = panel(spark, ["x1", "x2", "x3", "x4", "a", "b"], {"a": 2, "b": 1})
    assert p["mrr_at_5"] == pytest.approx(0.2) and p["recall_at_5"] == pytest.approx(0.5) and p["precision_at_5"] == pytest.approx(0.2)
    assert p["complete_evidence_recall_at_5"] == 0 and p["complete_evidence_recall_at_10"] == 1
    p = panel(spark, ["x", "a"], {"a": 1})
    assert p["binary_ndcg_at_10"] == pytest.approx(1 / math.log2(3))
    p = panel(spark, ["context", "direct"], {"direct": 2, "context": 1})
    assert p["binary_ndcg_at_10"] == pytest.approx(1) and p["graded_ndcg_at_10"] < 1
    p = panel(spark, [f"n{i}" for i in range(6)] + ["a"], {"a": 1})
    assert p["mrr_at_5"] == 0 and p["mrr_at_10"] == pytest.approx(1 / 7)
    assert panel(spark, ["a"], {"a": 0}) is None  # a query without positive judgment is refused


def test_rank_items_drops_repeats_and_bad_scores(spark):
    df = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "a", 0.5), ("q", "c", None), ("q", "d", float("nan"))], "q string, c string, s double")
    assert rows(metrics.rank_items(df, ["q"], "c", "s").select("c", "rank")) == [("a", 1), ("b", 2)]


def test_rrf(spark):
    lists = [("q", "a", "bm25", 1), ("q", "b", "bm25", 2), ("q", "b", "dense", 1), ("q", "a", "dense", 2), ("q", "c", "dense", 3)]
    out = retrieval.reciprocal_rank_fusion(spark.createDataFrame(lists, "q string, c string, s string, rank int"), "q", "c", "s").orderBy("rank").collect()
    assert [r["c"] for r in out] == ["a", "b", "c"]
    assert out[0]["score"] == out[1]["score"] == pytest.approx(round(1 / 61 + 1 / 62, 6))
    assert out[2]["score"] == pytest.approx(round(1 / 63, 6))


def test_holm_and_exact_signs(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5)], "t string, p double")
    assert [round(r["adjusted"], 6) for r in stats.holm(df, "t", "p").orderBy("p").collect()] == [0.03, 0.04, 0.5]


def _exact(values):
    nonzero = [v for v in values if v]
    sums = [sum(a * v for a, v in zip(signs, nonzero)) for signs in itertools.product((-1, 1), repeat=len(nonzero))]
    return sum(t >= sum(nonzero) - 1e-9 for t in sums) / len(sums)


def test_exact_signs_against_all_vectors(spark):
    groups = {"a": [0.5, -0.25, 0.125, 0.0, 0.0625, 0.3, None], "b": [1.0, 1.0, 1.0, 0.0], "c": [0.0, 0.0], "d": [-0.2, 0.2, -0.5, 0.1, 0.1, 0.1, 0.7, 0.9, 0.01, -0.03, 0.25, 0.25], None: [0.4]}
    df = spark.createDataFrame([(g, v, 1) for g, vs in groups.items() for v in vs], "g string, d double, test int")
    out = {r["g"]: r for r in stats.exact_signs(df, ["g"], "d").collect()}
    assert {g: r["p"] for g, r in out.items()} == {g: pytest.approx(_exact([v for v in vs if v is not None]), abs=1e-9) for g, vs in groups.items()}
    assert (out["a"]["n"], out["a"]["nonzero"]) == (6, 5)
    many = spark.createDataFrame([(0.5,)] * 60 + [(-0.5,)] * 40, "d double")
    assert stats.exact_signs(many, [], "d").first()["p"] == pytest.approx(sum(math.comb(100, k) for k in range(60, 101)) / 2**100, abs=1e-9)
    assert stats.exact_signs(df.limit(0), ["g"], "d").count() == 0


def test_resamples(spark):
    df = spark.createDataFrame([(f"q{i}", i % 2, float(i % 5)) for i in range(400)] + [("x", 0, None)], "q string, g int, d double")
    out = {r["g"]: r for r in stats.bootstrap_interval(df, ["g"], "q", "d", 500).collect()}
    assert out[0]["n"] == 200 and out[0]["mean"] == 2.0 and out[0]["low"] == pytest.approx(2 - 1.96 * 0.1, abs=0.05) and out[0]["high"] == pytest.approx(2 + 1.96 * 0.1, abs=0.05)
    flip = stats.sign_flip(spark.createDataFrame([(f"q{i}", 1.0 if i < 55 else -1.0) for i in range(100)], "q string, d double"), [], "q", "d", 2000).first()
    assert flip["observed"] == pytest.approx(0.1) and flip["p"] == pytest.approx(0.368, abs=0.05)
    assert stats.bootstrap_interval(df.limit(0), ["g"], "q", "d", 50).count() == 0


def test_kappa(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (0, 1), (2, 1), (0, None)], "l int, r int")
    out = metrics.cohen_kappa(df, "l", "r").first()
    same = (2 * 1 + 1 * 3 + 2 * 1) / 25
    assert out["pairs"] == 5 and out["kappa"] == pytest.approx((0.6 - same) / (1 - same))


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 4.0)], "x double, y double")
    x, y = [1, 2.5, 2.5, 4], [1, 2, 3, 4]
    mx, my = sum(x) / 4, sum(y) / 4
    want = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert stats.spearman(df, "x", "y").first()["rho"] == pytest.approx(want)


@pytest.mark.parametrize("n,want", [(300, [300]), (301, [300, 61]), (50, [50])])
def test_fixed_windows(spark, n, want):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n))), (2, ""), (3, None)], "k int, t string")
    out = chunking.word_windows(df, "k", "t").orderBy("chunk_index").collect()
    assert [r["end_word"] - r["start_word"] for r in out] == want
    if len(want) == 2:
        assert out[1]["start_word"] == 240 and out[1]["previous_overlap"] == 60
    with pytest.raises(ValueError):
        chunking.word_windows(df, "k", "t", 10, 10)


def test_sentence_windows_move_to_sentence_start(spark):
    words = [f"w{i}" for i in range(30)]
    words[11] = "end."
    df = spark.createDataFrame([(1, " ".join(words))], "k int, t string")
    out = chunking.sentence_windows(df, "k", "t", 10, 2, 5, 1).orderBy("chunk_index").first()
    assert out["end_word"] == 12


def test_text_functions(spark):
    assert one(spark, "HTTPS://EXAMPLE.GOV.IN/a//b/#fragment", text.canonical_url) == "https://example.gov.in/a/b"
    assert one(spark, "https://x.gov.in/a", text.authoritative_host) and not one(spark, "http://x.gov.in/a", text.authoritative_host)
    assert one(spark, "Page 3 of 9\nText\n\n\n\n\n12\nmore\x07", text.clean_text) == "Text\n\nmore"
    assert one(spark, "Education & Skills", text.organization_key) == "education and skills"
    assert one(spark, "What does it stand for?", text.category) == "terminology_heavy"
    assert one(spark, "SECTION ONE", text.heading_like) and not one(spark, "this is not one.", text.heading_like)
    assert one(spark, None, text.clean_text) is None


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, 500), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long"))))
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_row_numbers_and_running_sum(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("h"))
    out = ranking.row_number_in_groups(df, ["g"], F.col("h"), "r").collect()
    for g in range(3):
        own = sorted((r["h"], r["r"]) for r in out if r["g"] == g)
        assert [r for _, r in own] == list(range(1, len(own) + 1))
    total = dict(ranking.running_sum(df.select("id"), ["id"], F.col("id"), "s").collect())
    assert all(total[i] == i * (i + 1) // 2 for i in range(1000))


def test_shingle_pairs_match_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(60)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [" ".join(b[: rng.randint(50, 59)] + ["x"]) for b in base] + ["", None, "two words", "two words", "a b c d e"]
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if w:
            n = min(5, len(w))
            sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    for threshold in (0.6, 0.85):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
        got = {(r["a"], r["b"]) for r in dedup.shingle_pairs(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", threshold).collect()}
        assert got == want


def test_greedy_keep(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6)], "a long, b long")
    assert rows(dedup.greedy_keep(pairs)) == [(2, 1), (4, 3), (6, 5)]


@pytest.mark.parametrize("local_pairs", [0, 3, dedup.LOCAL_PAIRS])
def test_greedy_keep_names_the_first_kept(spark, local_pairs):
    # 9 pairs with 7, which is kept at once, and with 5, which is kept only after 2 is rejected
    pairs = spark.createDataFrame([(1, 2), (2, 5), (5, 9), (7, 9)], "a long, b long")
    assert rows(dedup.greedy_keep(pairs, local_pairs)) == [(2, 1), (9, 5)]


@pytest.mark.parametrize("local_pairs", [210, dedup.LOCAL_PAIRS])
def test_greedy_keep_settles_a_long_chain(spark, local_pairs):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(230)], "a long, b long")
    assert sorted(map(tuple, dedup.greedy_keep(pairs, local_pairs).collect())) == [(i, i - 1) for i in range(1, 231, 2)]


def test_graph_scores_by_hand(spark):
    seeds = spark.createDataFrame([("q", "s")], "q string, entity string")
    contains = spark.createDataFrame([("c1", "s"), ("c2", "t"), ("c3", "far")], "c string, entity string")
    co = spark.createDataFrame([("s", "t"), ("far", "t")], "a string, b string")
    freq = spark.createDataFrame([("s", 1)], "entity string, documents long")
    got = {r["c"]: r["score"] for r in graph.weighted_hop_ranking(seeds, contains, co, freq, 10, "q", "c").collect()}
    assert got == {"c1": pytest.approx((math.log(11 / 2) + 1) * 0.5), "c2": pytest.approx((math.log(11 / 2) + 1) * 0.25)}


@pytest.mark.parametrize(("frequent", "most"), [(62, 1000), (4, 1000), (62, 60), (0, 1)])
def test_weighted_hop_top_is_the_ranking_cut(spark, frequent, most):
    rng = random.Random(5)
    pool = [f"e{i}" for i in range(40)]
    held = [(f"c{i:03d}", e) for i in range(150) for e in {pool[min(int(rng.expovariate(0.15)), 39)] for _ in range(rng.randint(1, 4))}]
    co = sorted({(a, b) for c, a in held for d, b in held if c == d and a < b} | {("e1", "gone"), ("e3", "e39")})
    seeds = sorted({(q, e) for q in range(30) for e in rng.sample([*pool, "gone"], rng.randint(1, 4))} | {(99, "no such")})
    seeds, contains = spark.createDataFrame(seeds, "q long, entity string"), spark.createDataFrame(held, "c string, entity string")
    frequency = spark.createDataFrame([(e, 1 + i % 7) for i, e in enumerate([*pool, "gone"])], "entity string, documents long")
    edges = spark.createDataFrame(co, "a string, b string")
    whole = retrieval.top_k(graph.weighted_hop_ranking(seeds, contains, edges, frequency, 150, "q", "c"), "q", "c", "score", 10)
    top = retrieval.top_k(graph.weighted_hop_top(seeds, contains, edges, frequency, 150, "q", "c", 10, frequent, most), "q", "c", "score", 10)
    want = sorted(map(tuple, whole.select("q", "c", "seeds", "score", "rank").collect()))
    assert len(want) > 200 and sorted(map(tuple, top.select("q", "c", "seeds", "score", "rank").collect())) == want


@pytest.mark.parametrize(("block", "most", "slice_bytes"), [(16, 10**6, 1), (10**6, 200, 10**6)])
def test_two_step_top_is_the_best_paths_summed(spark, block, most, slice_bytes):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(25)]
    pairs = {(rng.choice(nodes), f"chunk:{rng.randrange(200):03d}") for _ in range(700)} | {tuple(rng.sample(nodes, 2)) for _ in range(60)}
    weight = {e: rng.choice([1, 1, 1, 2, 3]) for e in sorted(pairs)}
    weight |= {(b, a): w for (a, b), w in weight.items()}
    degree = {}
    for _, t in weight:
        degree[t] = degree.get(t, 0) + 1
    k = {(a, b): 0.5 * w / math.log2(degree[b] + 2) for (a, b), w in weight.items()}
    value = {n: rng.choice([1.0, 0.9, 0.6]) for n in nodes}
    seeds = [(q, n, value[n]) for q in range(20) for n in sorted(rng.sample(nodes, rng.randint(1, 4)))] + [(50, "alone", 0.6)]
    want = []
    for q in range(20):
        total = {}
        for n in [n for i, n, _ in seeds if i == q]:
            best = {}
            for (a, b), x in k.items():
                if a == n and b.startswith("chunk:"):
                    best[b] = max(best.get(b, 0), value[n] * x)
                elif a == n:
                    for (f, t), y in k.items():
                        if f == b and t.startswith("chunk:"):
                            best[t] = max(best.get(t, 0), value[n] * x * y)
            for t, x in best.items():
                total[t] = total.get(t, 0) + x
        want += [(q, t, round(x, 6), i + 1) for i, (t, x) in enumerate(sorted(total.items(), key=lambda p: (-round(p[1], 6), p[0]))[:10])]
    step = spark.createDataFrame([(a, b, w, degree[b]) for (a, b), w in weight.items()], "node string, t string, w long, degree long")
    top = graph.two_step_top(step, spark.createDataFrame(seeds, "query long, node string, weight double"), "query", "chunk:", 10, block, most, slice_bytes)
    assert sorted(map(tuple, retrieval.top_k(top, "query", "text", "score", 10).select("query", "text", "score", "rank").collect())) == sorted(want)


def test_phrase_spans(spark):
    texts = {"d": "\u0130 said: Gram  Sabha, (gram-sabha)\nx", "c": "one two three four five six seven eight", "e": '{"a": "gram sabha"}' + " y" * 200, "n": None}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    phrases = spark.createDataFrame([("gram sabha",), ("one two three four five six seven",), ("x",)], "p string")
    out = {(r["k"], r["phrase"], r["token_start"]): r for r in graph.phrase_spans(df, "k", "t", phrases, "p").collect()}
    assert sorted(out) == [("c", "one two three four five six seven", 1), ("d", "gram sabha", 3), ("d", "gram sabha", 5), ("d", "x", 7), ("e", "gram sabha", 2)]
    cut = {k: texts[k[0]][r["char_start"] : r["char_end"]] for k, r in out.items()}
    assert cut == {("c", "one two three four five six seven", 1): "one two three four five six seven", ("d", "gram sabha", 3): "Gram  Sabha", ("d", "gram sabha", 5): "gram-sabha", ("d", "x", 7): "x", ("e", "gram sabha", 2): "gram sabha"}
    for (k, _, _), r in out.items():
        assert r["excerpt"] == " ".join(texts[k][max(0, r["char_start"] - 110) : r["char_end"] + 150].split())


def test_one_match_for_each_entity(spark):
    texts = spark.createDataFrame([("q", "a b c a b b c")], "k string, t string")
    phrases = spark.createDataFrame([("a b", "x"), ("b c", "y"), ("a b c", "x"), ("c", "z")], "p string, e string")
    hits = graph.phrase_occurrences(texts, "k", "t", phrases, "p").join(phrases.withColumnRenamed("p", "phrase"), "phrase")
    assert rows(graph.longest_matches(hits, "k", "e")) == [("q", "x", "a b c", 0, 3), ("q", "y", "b c", 5, 2)]
    assert graph.longest_matches(hits.limit(0), "k", "e").count() == 0


def test_longest_match(spark):
    texts = spark.createDataFrame([("q", "the urban water scheme of the state"), ("r", None)], "k string, t string")
    phrases = spark.createDataFrame([("urban water",), ("urban water scheme",), ("water",), ("the state",), ("sch",), ("no " * 40 + "end",), ("",), (None,)], "p string")
    hits = graph.phrase_occurrences(texts, "k", "t", phrases, "p")
    assert rows(graph.longest_matches(hits.withColumn("e", F.col("phrase")), "k", "e").select("phrase")) == [("the state",), ("urban water scheme",)]


def test_bm25_against_formula(spark):
    docs = {1: "bm25 ranking function bm25", 2: "dense vectors rank", 3: "graph walk ranking", 4: None, 5: "other words here"}
    q = "bm25 ranking function"
    toks = {k: t.split() for k, t in docs.items() if t}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - x + 0.5) - math.log(x + 0.5) for w, x in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    want = {k: sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in q.split() if w in t) for k, t in toks.items()}
    index = retrieval.Bm25Index(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text")
    got = {r["doc"]: r["score"] for r in index.search(spark.createDataFrame([("q", q)], "qid string, question string"), "qid", "question").collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items() if set(q.split()) & set(toks[k])}


def test_vectors_find_themselves_last(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(99, None)], "i long, v array<float>")
    out = retrieval.nearest_vectors(df, df.where("i % 10 = 0"), "i", "v", 3).collect()
    assert len(out) == 12 and all(r["query"] != r["item"] for r in out)
    l2 = retrieval.nearest_vectors(df, df.where("i = 0"), "i", "v", 1, "l2").first()
    assert (l2["item"], l2["score"]) == (21, 1.0)
    many = retrieval.nearest_vectors(df, df, "i", "v", 2, block=7)
    assert many.count() == 80


def test_entity_registry_by_hand(spark):
    rows_ = [
        ("d1", "Clean Water Scheme (CWS)", "Ministry of Water & Works", "Water Department", "The Ministry of Water and Works runs the Rural Roads Act 2001. XQ: Village Mapping Board (VMB) report."),
        ("d2", "Clean Water Scheme", "Ministry of Water and Works", None, "Nothing under the clean water scheme, the CWS."),
        ("d3", "Of Old", "Scheme", None, None), ("d4", None, None, None, "of the Clean Air Policy"),
    ]
    docs = spark.createDataFrame(rows_, "doc string, title string, ministry string, department string, text string")
    out, names = entities.registry(docs)
    got = {(r["kind"], r["norm"]): (r["document_frequency"], r["reason"]) for r in out.collect()}
    assert got["scheme", "clean water scheme"] == (2, None) and got["scheme", "of old"] == (1, None)
    assert got["ministry", "scheme"][1] == "generic_entity" and got["controlled_acronym", "xq"][1] == "unpaired_uppercase_token"
    assert got["controlled_acronym", "village mapping board"] == (1, None) and got["law_or_policy", "rural roads act 2001"] == (1, None)
    assert got["ministry", "ministry of water works"] == (1, None) and got["ministry", "ministry of water and works"] == (2, None)
    assert {(r["norm"], r["alias"]) for r in names.where("alias <> norm").collect()} == {("clean water scheme", "cws"), ("village mapping board", "vmb")}
    groups = {r["norm"]: r["component"] for r in entities.organisation_groups(docs, out).collect()}
    assert groups["ministry of water works"] == groups["ministry of water and works"] != groups["water department"]
    asked = spark.createDataFrame([("q", "Is the CWS of the Clean Water Scheme or the VMB due?"), ("r", None)], "q string, t string")
    assert rows(entities.resolve(asked, "q", "t", names).select("norm", "alias")) == [("clean water scheme", "clean water scheme"), ("village mapping board", "vmb")]
    chunks = spark.createDataFrame([("c2", "d1", "none"), ("c1", "d1", "the VMB"), ("c3", "d2", "clean water scheme, vmb"), ("c4", "d2", None)], "chunk string, doc string, text string")
    found = entities.mentions(docs, chunks, names)
    assert ("scheme", "clean water scheme", "c1", False, True) in rows(found) and ("controlled_acronym", "village mapping board", "c3", True, False) in rows(found)
    assert ("controlled_acronym:village mapping board", "scheme:clean water scheme", 2) in rows(entities.co_mentions(found))
    empty, no_names = entities.registry(docs.limit(0))
    assert empty.count() == 0 and entities.resolve(asked, "q", "t", no_names).count() == 0
