"""Personal data in free text: overlapping candidates, boosted trees, calibrated thresholds."""

from __future__ import annotations

import hashlib
import inspect
import json
import pickle
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import boosting, pii_candidates, pii_examples
from rillmark.llm.boosting import BoostedTrees, best_threshold
from rillmark.llm.pii_candidates import TYPES, Lexicon, Rows, candidates
from rillmark.llm.pii_examples import labelled_texts
from rillmark.session import shared_folder, with_package

#: Most labelled texts the classifiers are fitted on, and the share held out for the thresholds.
TRAINING_TEXTS = 4000
HELD_OUT = 0.25
#: Most known names that fill the labelled texts, chosen by hash; whether a token is known is asked of all names.
SAMPLE_NAMES = 5000
#: Most bits of the filter of all known names of a kind (32 MB); 32 bits a name as long as they suffice.
MOST_BITS = 1 << 28
_PROBES = 7
#: Texts judged at once in a task.
SLICE = 500


class KnownTokens:
    """A Bloom filter of any number of tokens, asked with ``in``."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def __contains__(self, token: str) -> bool:
        bits = len(self.words) * 64
        return all(int(self.words[p >> 6]) >> (p & 63) & 1 for p in _probes(token, bits))


def _probes(token: str, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(token)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(_PROBES)]


def _known_tokens(known_names: DataFrame, kind: str) -> KnownTokens:
    """The filter of the names of one kind, its words put together by the tasks."""
    names = known_names.where((F.col("name_kind") == kind) & (F.length("name_token") > 0)).select(F.lower("name_token").alias("name")).distinct()
    bits = min(MOST_BITS, max(1 << 12, 1 << (32 * names.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.array([p for t in b["name"] for p in _probes(t.lower(), bits)], dtype=np.int64)
            yield pd.DataFrame({"word": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    words = np.zeros(bits // 64, dtype=np.int64)
    for r in with_package(names).mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toLocalIterator():  # at most bits / 64 rows
        words[r["word"]] = r["mask"]
    return KnownTokens(words.view(np.uint64))


class Detector:
    """One classifier and one threshold for each type of personal data."""

    def __init__(self, lexicon: Lexicon, models: list[BoostedTrees], thresholds: list[float]) -> None:
        self.lexicon, self.models, self.thresholds = lexicon, models, thresholds

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Accepted spans of each text from left to right; of overlapping ones the surest, of equals the longest, stays."""
        found = [candidates(t, self.lexicon) if t else [] for t in texts]
        rows = Rows(self.lexicon)
        for t, f in zip(texts, found):
            if f:
                rows.add(t, f)
        tables = rows.tables()
        kinds = np.array([f[2] for fs in found for f in fs], dtype=int)
        sure = np.zeros(len(kinds))
        for k, (model, threshold) in enumerate(zip(self.models, self.thresholds)):
            own = np.flatnonzero(kinds == k)
            if len(own):
                p = model.probability(tables[k])
                sure[own] = np.where(p > threshold, p, 0)
        out, first = [], 0
        for fs in found:
            own = [(-round(float(p), 4), c[0] - c[1], *c[:3]) for p, c in zip(sure[first : first + len(fs)], fs) if p > 0]
            first += len(fs)
            taken: list[tuple[int, int, str]] = []
            for _, _, s, e, k in sorted(own):
                if all(e <= a or s >= b for a, b, _ in taken):
                    taken.append((s, e, TYPES[k]))
            out.append(sorted(taken))
        self.lexicon.trim()
        return out


def fit_detector(names: list[tuple[str, str]], count: int = TRAINING_TEXTS, seed: int = 42, given=None, family=None, kinds: tuple[str, ...] | None = None) -> Detector:
    """Fit on ``count`` labelled texts; the thresholds come from those held out.

    ``names`` is a sample of the known names; ``given`` and ``family`` tell of any token whether it is known
    (by default the sample itself).
    """
    texts = labelled_texts(count, list({t for t, k in names if k == "given"}), list({t for t, k in names if k == "family"}), seed, kinds)
    # Half of the known names are hidden from the features in each text, as many names in use are not known.
    half = [Lexicon([n for i, n in enumerate(sorted(names)) if i % 2 == h]) for h in (0, 1)]
    hidden = random.Random(seed)
    for lex in half:
        lex.public = {t: k for t, k in sorted(lex.public.items()) if hidden.random() < 0.5}
    rows = [Rows(lex) for lex in half]
    labels, spans_of, text_of = [[] for _ in TYPES], [[] for _ in TYPES], [[] for _ in TYPES]
    for i, (text, spans) in enumerate(texts):
        lex = half[i % 2]
        found = candidates(text, lex)
        truth = set(spans)
        rows[i % 2].add(text, found)
        for c in found:
            k = c[2]
            labels[k].append((c[0], c[1], TYPES[k]) in truth)
            spans_of[k].append(c[:2])
            text_of[k].append(i)
    tables = [r.tables() for r in rows]
    models, thresholds = [], []
    for k in range(len(TYPES)):
        where = np.array(text_of[k])
        x, y = np.empty((len(where), tables[0][k].shape[1]), dtype=np.float32), np.array(labels[k], dtype=float)
        for h in (0, 1):
            x[where % 2 == h] = tables[h][k]
        held = where >= count * (1 - HELD_OUT)
        model = BoostedTrees().fit(x[~held], y[~held])
        own = np.flatnonzero(held)
        p = model.probability(x[own])
        taken: dict[int, list[tuple[int, int]]] = {}  # of overlapping candidates only the surest can be accepted, so only it counts
        kept = []
        for j in np.argsort(-p, kind="stable"):
            s, e = spans_of[k][own[j]]
            others = taken.setdefault(text_of[k][own[j]], [])
            if all(e <= a or s >= b for a, b in others):
                others.append((s, e))
                kept.append(j)
        models.append(model)
        thresholds.append(min(0.9, max(0.05, best_threshold(p[kept], y[own[kept]]))))
    return Detector(Lexicon(names, given, family), models, thresholds)


def _models(spark: SparkSession, names: list[tuple[str, str]]) -> tuple[list[BoostedTrees], list[float]]:
    """The fitted classifiers and thresholds, kept in the shared folder under a hash of what they are fitted on."""
    source = "".join(inspect.getsource(m) for m in (boosting, pii_candidates, pii_examples))
    digest = hashlib.sha256(json.dumps([sorted(names), TRAINING_TEXTS, HELD_OUT, source]).encode()).hexdigest()[:32]
    path = f"{shared_folder(spark)}/rillmark-models/pii-{digest}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        plain = json.loads(spark.read.schema("model string").parquet(path).first()["model"])
        return [BoostedTrees.loaded(m) for m in plain["models"]], plain["thresholds"]
    fitted = fit_detector(names)
    plain = json.dumps({"models": [m.saved() for m in fitted.models], "thresholds": fitted.thresholds})
    spark.createDataFrame([(plain,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)
    return fitted.models, fitted.thresholds


def _detector(known_names: DataFrame):
    spark = known_names.sparkSession
    chosen = known_names.select("name_token", "name_kind").where("length(name_token) > 0 and name_kind in ('given', 'family')").distinct()
    names = [(r[0], r[1]) for r in chosen.orderBy(F.xxhash64("name_token", "name_kind"), "name_token", "name_kind").limit(SAMPLE_NAMES).collect()]
    models, thresholds = _models(spark, names)
    lexicon = Lexicon(names, *[_known_tokens(known_names, kind) for kind in ("given", "family")])
    return spark.sparkContext.broadcast(pickle.dumps(Detector(lexicon, models, thresholds)))


def _apply(df: DataFrame, doc_col: str, text_col: str, known_names: DataFrame, make, schema: str) -> DataFrame:
    shared = _detector(known_names)
    rows = df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(shared.value)
        for b in batches:
            texts = list(b["text"])  # a slice at a time, as candidates and features take more room than texts
            found = [f for i in range(0, len(texts), SLICE) for f in detector.spans(texts[i : i + SLICE])]
            yield make(b, found)

    return with_package(rows).mapInPandas(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {schema}").withColumnRenamed("doc", doc_col)


def find_personal_data(df: DataFrame, doc_col: str, text_col: str, known_names: DataFrame) -> DataFrame:
    """Every piece of personal data: ``doc_col``, ``pii_type``, ``pii_text`` (as it stands), ``start``, ``end`` in characters.

    Generators propose overlapping spans of each type, boosted trees judge them by format and context, and
    those above the threshold fitted for their type stay, the surest first. The classifiers are fitted once on
    ``TRAINING_TEXTS`` labelled texts, kept in the shared folder, and know the names of ``known_names``
    (name_token, name_kind), however many, and the endings of ``SAMPLE_NAMES`` of them. Null and empty texts have none; extra columns are ignored; one scan, no shuffle.
    """

    def make(b: pd.DataFrame, found: list) -> pd.DataFrame:
        rows = [(d, k, t[s:e], s, e) for d, t, spans in zip(b["doc"], b["text"], found) for s, e, k in spans]
        return pd.DataFrame(rows, columns=["doc", "pii_type", "pii_text", "start", "end"])

    return _apply(df, doc_col, text_col, known_names, make, "pii_type string, pii_text string, start int, end int")


def redact_personal_data(df: DataFrame, doc_col: str, text_col: str, known_names: DataFrame) -> DataFrame:
    """``doc_col``, ``redacted`` with a placeholder such as ``[EMAIL]`` for each piece, and ``pieces``; a null text stays null."""

    def make(b: pd.DataFrame, found: list) -> pd.DataFrame:
        texts = []
        for t, spans in zip(b["text"], found):
            for s, e, k in reversed(spans):
                t = f"{t[:s]}[{k.upper()}]{t[e:]}"
            texts.append(t)
        return pd.DataFrame({"doc": b["doc"], "redacted": texts, "pieces": [len(s) for s in found]})

    return _apply(df, doc_col, text_col, known_names, make, "redacted string, pieces int")
