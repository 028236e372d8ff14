"""Brute force, held-out accuracy and edge cases for near-duplicates, leakage and personal data."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest

from rillmark.llm import leakage, near_duplicates, pii, pii_examples, words

WORD = re.compile(r"[^\W_]+")


def shingles(text, k=5):
    w = WORD.findall(text.lower())
    n = min(k, len(w))
    return frozenset(zip(*(w[i:] for i in range(n)))) if w else frozenset()


def test_words_agree_with_the_definition():
    for t in ("Plain ASCII_text, 12.5%", "naïve Straße x²", "हिंदी पाठ 12", "", "___", "A" * 50_000):
        assert words.words(t) == [w.encode() for w in WORD.findall(t.lower())]


def near_texts():
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            edited = list(base)
            for _ in range(rng.randint(0, 6)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts.append(rng.choice((" ", ", ", "\n")).join(edited))
    block = texts[0].split()
    texts.append(" ".join(block[15:] + block[:15]))
    return texts + [None, "", "...", "two words", "Two, words", "two words more", "one", "x " * 30_000, texts[3], texts[3].upper()]


def test_similar_pairs_match_brute_force(spark):
    texts = near_texts()
    rows = [(i, "s" if i % 5 else "other", t, "c", "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, kind string, text string, class string, rep string")
    links, members = near_duplicates.similar_classes(df, "id", "kind", "text")
    got = {(r["row_a"], r["row_b"]) for r in near_duplicates.similar_pairs(links, members).collect()}
    sets = {i: (k, shingles(t)) for i, k, t, *_ in rows if t and shingles(t)}
    want = set()
    for a, (ka, x) in sets.items():
        for b, (kb, y) in sets.items():
            if a < b and ka == kb and len(x & y) >= 0.8 * len(x | y):
                want.add((a, b))
    assert got == want and len(want) > 20
    groups = near_duplicates.similarity_groups(links, members).collect()
    assert len(groups) == len(sets)
    of = {r["key"]: r["group_key"] for r in groups}
    assert all(of[a] == of[b] for a, b in want)
    e_links, e_members = near_duplicates.similar_classes(df.limit(0), "id", "kind", "text")
    assert e_links.count() == 0 and near_duplicates.similar_pairs(e_links, e_members).count() == 0
    assert near_duplicates.similarity_groups(e_links, e_members).count() == 0


def test_many_candidate_keys_take_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BROADCAST_KEYS", 0)
    df = spark.createDataFrame([(1, "s", "a b c d e f g h"), (2, "s", "a b c d e f g h"), (3, "s", "a b c d e f g h i")], "id long, kind string, text string")
    links, members = near_duplicates.similar_classes(df, "id", "kind", "text")
    assert {(r["row_a"], r["row_b"]) for r in near_duplicates.similar_pairs(links, members).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_odd_sketch_bound_passes_pairs_at_the_threshold():
    p = near_duplicates.Sketching()
    assert 60 < p.most_differing_bits < 110
    assert (1 - p.similarity**p.rows) ** p.bands < 1e-6


@pytest.mark.parametrize("bits,broadcast", [(1 << 28, "10MB"), (64, "-1")])
def test_leakage_matches_brute_force(spark, monkeypatch, bits, broadcast):
    """Also with a filter that is full and a join by shuffle."""
    monkeypatch.setattr(leakage, "MOST_BITS", bits)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        _leakage(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _leakage(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 25))
    passages = [(i % 9, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(18)] + [(20, None), (21, ""), (22, "a0 a0 a0 a0 a0 a0 a0 a0 a0 a0 a0 a0")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            source = rng.choice(passages[:18])[1].split()
            n = rng.choice([10, 11, 12, 13, len(source)])
            a = rng.randint(0, max(0, len(source) - n))
            at = rng.randint(0, len(body))
            body[at:at] = source[a : a + n]
        docs.append((i, " ".join(body)))
    docs += [(500, None), (501, ""), (502, "a0 " * 40), (503, docs[3][1]), (503, docs[3][1])]
    grams = defaultdict(set)
    for item, p in passages:
        w = WORD.findall((p or "").lower())
        for j in range(len(w) - 11):
            grams[tuple(w[j : j + 12])].add(item)
    want = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for j in range(len(w) - 11):
            want |= {(d, x) for x in grams.get(tuple(w[j : j + 12]), ())}
    df = spark.createDataFrame([(*x, 1, 1) for x in docs], "doc_id long, text string, item int, fingerprint int")
    items = spark.createDataFrame(passages, "item_id long, passage string")
    got = {tuple(r) for r in leakage.leaked_items(df, "doc_id", "text", items, "item_id", "passage").collect()}
    assert got == want and len(want) > 20
    keyed = df.where("doc_id <> 503")
    numbered = spark.createDataFrame([(i, n, p) for n, (i, p) in enumerate(passages)], "item_id long, n long, passage string")
    spans = leakage.leaked_spans(keyed, "doc_id", "text", numbered, "item_id", "n", "passage").collect()
    word_of = {d: WORD.findall((t or "").lower()) for d, t in docs if d != 503}
    passage_of = [WORD.findall((p or "").lower()) for _, p in passages]
    runs = set()
    for d, w in word_of.items():
        for n, q in enumerate(passage_of):
            for a in range(len(w)):
                for b in range(len(q)):
                    if w[a] == q[b] and not (a and b and w[a - 1] == q[b - 1]):
                        k = 0
                        while a + k < len(w) and b + k < len(q) and w[a + k] == q[b + k]:
                            k += 1
                        if k >= 12:
                            runs.add((d, passages[n][0], n, a, b, k))
    assert {(r["doc_id"], r["item_id"], r["n"], r["start_word"], r["passage_word"], r["words"]) for r in spans} == runs and len(runs) == len(spans)
    assert leakage.leaked_items(df.limit(0), "doc_id", "text", items, "item_id", "passage").count() == 0
    assert leakage.leaked_items(df, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


NAMES = [(g + e, "given") for g in ("Bran", "Cas", "Ner", "Lor", "Vin", "Mel", "Tav", "Zor") for e in ("ith", "enda", "ulo", "anya")] + [
    (f + e, "family") for f in ("Bax", "Hol", "Lak", "Nor", "Pas", "Sav", "Wex", "Gri") for e in ("akal", "rekar", "ghe", "moor")
]


def test_held_out_kinds():
    """Each kind of text but the first is judged by a detector that saw none of its sentences."""
    given, family = [t for t, k in NAMES if k == "given"], [t for t, k in NAMES if k == "family"]
    kinds, hit, said, true = list(pii_examples.TEXT_KINDS), Counter(), Counter(), Counter()
    for fold in range(4):
        out = tuple(k for i, k in enumerate(kinds) if i and i % 4 == fold)
        detector = pii.fit_detector(NAMES, 2500, kinds=tuple(k for k in kinds if k not in out))
        texts = pii_examples.labelled_texts(300, given, family, 7, out)
        for found, (_, truth) in zip(detector.spans([t for t, _ in texts]), texts):
            hit.update(k for _, _, k in set(found) & set(truth))
            said.update(k for _, _, k in found)
            true.update(k for _, _, k in truth)
    for kind in ("email", "phone", "id_number", "address", "name"):
        assert hit[kind] / said[kind] > 0.9 and hit[kind] / true[kind] > 0.9, (kind, hit[kind], said[kind], true[kind])


def test_wording_of_other_hands():
    detector = pii.fit_detector(NAMES, 3000)
    cases = {
        "For the ration list ring our clerk on 98765 43210 before noon.": [("phone", "98765 43210")],
        "He wrote the identity number 2345 6789 0123 on the slip.": [("id_number", "2345 6789 0123")],
        "The parcel was taken by Suresh Iyer last week.": [("name", "Suresh Iyer")],
        "She moved to 221 Lake View Apartments, MG Road, Bengaluru 560001 in May.": [("address", "221 Lake View Apartments, MG Road, Bengaluru 560001")],
        "बैठक में राम प्रसाद ने अपनी बात रखी।": [("name", "राम प्रसाद")],
        "The Reserve Bank of India and Indian Railways signed on 12.03.2020.": [],
        "Rs. 37,000 was paid on 16 July 2013 for 15,301 sacks.": [],
    }
    for text, want in cases.items():
        assert [(k, text[s:e]) for s, e, k in detector.spans([text])[0]] == want
    plain = [(m.saved(), t) for m, t in zip(detector.models, detector.thresholds)]
    again = pii.Detector(detector.lexicon, [pii.BoostedTrees.loaded(json.loads(json.dumps(m))) for m, _ in plain], [t for _, t in plain])
    assert again.spans(list(cases)) == detector.spans(list(cases))


def test_known_tokens(spark):
    names = [(f"Name{i}", "given") for i in range(5000)] + [("Other", "family"), (None, "given"), ("", "given"), ("Ünal", "given")]
    known = pii._known_tokens(spark.createDataFrame(names, "name_token string, name_kind string"), "given")
    assert all(f"name{i}" in known for i in range(5000)) and "ünal" in known
    assert sum(f"word{i}" in known for i in range(20_000)) < 20
    assert "x" not in pii._known_tokens(spark.createDataFrame([], "name_token string, name_kind string"), "given")


def test_redaction_keeps_the_rest(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRAINING_TEXTS", 1500)
    texts = [
        (1, "Write to nerith.baxakal@pinbox.example before 4 May 2020. Toll-free line 1800-000-1531 is open."),
        (2, None), (3, ""), (4, "No data here."), (5, "x" * 200_000), (6, "Her PAN ABCDE1234F was typed wrongly. Tender ABCDE1234F/14 closes on 2 May 2020."), (6, "No data here."),
    ]
    df = spark.createDataFrame([(*t, "a", "b") for t in texts], "doc_id long, text string, doc string, pii_type string")
    names = spark.createDataFrame(NAMES, "name_token string, name_kind string")
    found = pii.find_personal_data(df, "doc_id", "text", names).collect()
    assert {(r["doc_id"], r["pii_type"], r["pii_text"]) for r in found} == {(1, "email", "nerith.baxakal@pinbox.example"), (6, "id_number", "ABCDE1234F")}
    text_of = dict(texts[:6])
    assert all(text_of[r["doc_id"]][r["start"] : r["end"]] == r["pii_text"] for r in found)
    red = {r["doc_id"]: r["redacted"] for r in pii.redact_personal_data(df, "doc_id", "text", names).where("redacted is null or redacted <> 'No data here.'").collect()}
    assert red[1] == "Write to [EMAIL] before 4 May 2020. Toll-free line 1800-000-1531 is open."
    assert red[2] is None and red[3] == "" and red[6] == "Her PAN [ID_NUMBER] was typed wrongly. Tender ABCDE1234F/14 closes on 2 May 2020."
    assert pii.find_personal_data(df.limit(0), "doc_id", "text", names).count() == 0
    assert pii.find_personal_data(df, "doc_id", "text", names.limit(0)).count() >= 1
