"""Toxic passages as maximum-scoring segments of token log-odds, and a calibrated score per document."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .store import free_name, label_sample, stored, text_of
from .tokens import slices

#: Characters at both ends of a word that are no part of its token.
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: A token is a word or its beginning of so many letters.
STEMS = (4, 5, 6, 7)
#: Bytes of text that a task scans at a time.
AT_ONCE = 1 << 20
#: Decays that the law of extreme values is tried with.
DECAYS = np.linspace(0.1, 3.0, 59)


@dataclass
class Model:
    """Scores of the tokens that differ between toxic and other texts, and the calibration of segments."""

    scores: dict[str, float]
    other: float
    decay: float = 1.0
    scale: float = 1.0
    intercept: float = 0.0
    slope: float = 1.0


def tokens_of(word: str) -> list[str]:
    """The word in lower case without signs at its ends, then its stems, each marked by its length."""
    word = EDGES.sub("", word.lower())
    if not word:
        return []
    return [word, *(f"{word[:n]}*" for n in reversed(STEMS) if len(word) >= n)]


def segments(places: list[int], gains: list[float], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first word, last word, score), in one scan from left to right.

    ``gains`` are the scores of the words at ``places``; every word between them scores ``other``, which is below 0.
    The list keeps, for each candidate, the sum of all scores before it and up to its end. A new candidate joins an
    older one when that one begins lower and ends lower; the middle ones go with it.
    """
    kept: list[tuple[int, int, float, float]] = []
    total, before = 0.0, -1
    for place, gain in zip(places, gains):
        total += other * (place - before - 1)
        before = place
        left, right = total, total + gain
        total = right
        if gain <= 0:
            continue
        first, last = place, place
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= left:
                at -= 1
            if at < 0 or kept[at][3] >= right:
                break
            first, left = kept[at][0], kept[at][2]
            del kept[at:]
        kept.append((first, last, left, right))
    return [(first, last, right - left) for first, last, left, right in kept]


def _scored_words(texts: pa.Array, model: Model) -> Iterator[tuple[int, list[int], list[float]]]:
    """For each text: its number of words, and the places and scores of the words that the model knows."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    bounds = split.offsets.to_numpy()
    coded = split.values[bounds[0]:bounds[-1]].dictionary_encode()
    scores = model.scores
    known = np.full(len(coded.dictionary) + 1, np.nan)
    for i, word in enumerate(coded.dictionary.to_pylist()):
        for token in tokens_of(word):
            if token in scores:
                known[i] = scores[token]
                break
    flat = known[coded.indices.to_numpy(zero_copy_only=False)]
    hit = np.flatnonzero(~np.isnan(flat))
    starts = (bounds - bounds[0]).astype(np.int64)
    cuts = np.searchsorted(hit, starts)
    for i in range(len(texts)):
        part = hit[cuts[i]:cuts[i + 1]]
        yield int(starts[i + 1] - starts[i]), (part - starts[i]).tolist(), flat[part].tolist()


def _parts(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """The columns, the first of which holds texts, cut by bytes of text."""
    rows = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    for part in slices(rows, "0", AT_ONCE):
        yield part.columns


def evidence(n_words: int, found: list[tuple[int, int, float]], model: Model) -> float:
    """Sum over segments of how far each passes the score expected by chance in so many words (extreme-value law)."""
    if not found:
        return 0.0
    chance = math.log(max(model.scale, 1e-12) * max(n_words, 1))
    return sum(max(0.0, model.decay * score - chance) for _, _, score in found)


def score_of(x: float, model: Model) -> float:
    z = model.intercept + model.slope * x
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic and other texts that hold it) of rows (text, label)."""
    def run(batches):
        for texts, labels in (part for batch in batches for part in _parts(*batch.columns)):
            split = pc.ascii_split_whitespace(texts.fill_null(""))
            bounds = split.offsets.to_numpy()
            coded = split.values[bounds[0]:bounds[-1]].dictionary_encode()
            index: dict[str, int] = {}
            of_word = [[index.setdefault(t, len(index)) for t in tokens_of(w)] for w in coded.dictionary.to_pylist()]
            at = coded.indices.to_numpy(zero_copy_only=False)
            seen = np.zeros((2, len(index) + 1), np.int64)
            for i, label in enumerate(labels.to_pylist()):
                words = np.unique(at[bounds[i] - bounds[0]:bounds[i + 1] - bounds[0]])
                held = {t for w in words.tolist() for t in of_word[w]}
                seen[label, list(held)] += 1
            names = list(index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(seen[1, :len(names)]), pa.array(seen[0, :len(names)])],
                names=["token", "toxic", "other"])

    found = rows.mapInArrow(run, "token string, toxic long, other long")
    return found.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train_rows(docs: DataFrame, labels: DataFrame, keep: Column | None, most: int,
               id_column: str, text_column: str, label_column: str) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents, each distinct text once.

    The sample takes the labels of smallest id hash, so it is the same in each run; its bound makes it safe to send
    to all tasks. Of more distinct texts, if ids repeat, those of smallest hash stay. Labels other than 0 and 1 and null ids are left out; of several labels of an id the largest counts.
    The limit is found on hashes alone, so no task gathers the texts.
    """
    sample = label_sample(labels, keep, most, id_column, label_column)
    rows = (docs.select(docs[id_column].alias("_id"), text_of(docs, text_column).alias("text"))
            .join(F.broadcast(sample), "_id"))
    distinct = stored(rows.groupBy(F.sha2("text", 256).alias("_hash")).agg(F.first("text").alias("text"), F.max("label").alias("label")), "training")
    # the least hash that goes; null where there are no more texts than that, and then all stay
    beyond = distinct.select("_hash").orderBy("_hash").offset(most).limit(1).agg(F.min("_hash").alias("_beyond"))
    return distinct.crossJoin(F.broadcast(beyond)).where("_beyond IS NULL OR _hash < _beyond").select("text", "label")


def fit(rows: DataFrame, prior: float = 50.0, least_z: float = 4.0, most_tokens: int = 20_000) -> Model:
    """Learn the model from (text, label) rows.

    Each token gets the log-odds of standing in a toxic text against another one, with a Dirichlet prior of weight
    ``prior`` that follows the token's share of all texts, and half a text at least, so that a word that stands in
    toxic texts only is judged by how many they are, however large the sample. Tokens whose log-odds pass ``least_z``
    standard deviations are kept, at most ``most_tokens`` of them, strongest first; all other words share one small
    negative score, so segments end. The law of extreme values is fitted to texts without the label: its decay is where
    the mean of exp(decay * score) over their words is 1, its scale follows from how many segments they have. A
    logistic curve turns the summed evidence into a probability. Without toxic or without other rows the score is the share of
    toxic labels.
    """
    rows = rows.persist(StorageLevel.DISK_ONLY)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_tox, n_other = n.get(1, 0), n.get(0, 0)
    if not n_tox or not n_other:
        rows.unpersist()
        share = (n_tox + 0.01) / (n_tox + n_other + 1)
        return Model({}, -1.0, intercept=math.log(share / (1 - share)), slope=0.0)
    share = (F.col("toxic") + F.col("other")) / F.lit(float(n_tox + n_other))
    a = F.greatest(F.lit(prior) * share, F.lit(0.5))
    b = F.lit(prior) * (1 - share)
    odds = (F.log((F.col("toxic") + a) / (n_tox - F.col("toxic") + b + 1e-9))
            - F.log((F.col("other") + a) / (n_other - F.col("other") + b + 1e-9)))
    deviation = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("other") + a))
    found = (_token_counts(rows).where(F.col("toxic") + F.col("other") >= 5)
             .select("token", odds.alias("odds"), (odds / deviation).alias("z"))
             .where((F.abs("z") >= least_z) & (F.abs("odds") >= math.log(2)))
             .orderBy(F.abs("z").desc(), "token").limit(most_tokens).collect())
    # a stem speaks for words that are rare by themselves
    scores = {r["token"]: float(r["odds"]) for r in found}
    model = Model(scores, -0.25)

    def run(batches):
        for texts, labels, hashes in (part for batch in batches for part in _parts(*batch.columns)):
            out = []
            for (words, places, gains), label, key in zip(_scored_words(texts, model), labels.to_pylist(), hashes.to_pylist()):
                found = segments(places, gains, model.other)
                powers = np.exp(np.outer(DECAYS, gains)).sum(axis=1) if label == 0 else []
                out.append((label, words, len(places), [s for _, _, s in found], powers, key))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)],
                                             names=["label", "words", "known", "segments", "powers", "hash"])

    hashed = rows.select("text", "label", F.sha2("text", 256))
    scored = hashed.mapInArrow(run, "label int, words long, known long, segments array<double>, powers array<double>, hash string").collect()
    rows.unpersist()
    # floating sums depend on the order of rows, which tasks don't fix
    scored.sort(key=lambda r: (r["hash"] or "", r["label"]))
    clean = [r for r in scored if r["label"] == 0]
    words, known = sum(r["words"] for r in clean), sum(r["known"] for r in clean)
    model.decay = _decay(words, known, np.sum([r["powers"] for r in clean], axis=0), model.other)
    # segments of one word by chance: the smallest gain, met so often in so many words
    base = min((s for s in scores.values() if s > 0), default=1.0)
    above = sum(1 for r in clean for x in r["segments"] if x >= base)
    model.scale = (above + 1) / (words + 1) * math.exp(model.decay * base)
    xs = np.array([evidence(r["words"], [(0, 0, s) for s in r["segments"]], model) for r in scored])
    ys = np.array([r["label"] for r in scored], float)
    model.intercept, model.slope = _logistic(np.log1p(xs), ys)
    return model


def _decay(words: int, known: int, powers: np.ndarray, other: float) -> float:
    """The decay, between the least and the greatest of DECAYS, at which the mean of exp(decay * score) over words is 1."""
    means = ((words - known) * np.exp(DECAYS * other) + powers) / max(words, 1)
    above = np.flatnonzero(means >= 1)
    if not len(above):
        return float(DECAYS[-1])
    at = int(above[0])
    if not at:
        return float(DECAYS[0])
    return float(np.interp(1.0, means[at - 1:at + 1], DECAYS[at - 1:at + 1]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a small ridge; the slope is never negative."""
    m = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -40, 40)))
        h = (m * (p * (1 - p) + 1e-9)[:, None]).T @ m + ridge * np.eye(2)
        step = np.linalg.solve(h, m.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def score(docs: DataFrame, model: Model, text_column: str = "text", keep: list[str] | None = None,
          with_passages: bool = False, score_name: str = "score") -> DataFrame:
    """The columns ``keep`` of each document and its toxicity ``score`` between 0 and 1.

    With passages there is also ``passages``: the significant segments as (first word, last word, score), words
    counted from 0. A null or empty text has no segment and gets the model's lowest score. Rows stay as they are,
    repeated ones included; a column that is called like the score gives way to it.
    """
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_column]) if c.lower() != score_name.lower()]
    passage = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
    judged = pa.struct([("score", pa.float64()), ("passages", pa.list_(passage))])

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("score", T.DoubleType())])))]))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for (texts,) in _parts(batch):
                for words, places, gains in _scored_words(texts, model):
                    found = segments(places, gains, model.other) if places else []
                    spans = None
                    if with_passages:
                        chance = math.log(max(model.scale, 1e-12) * max(words, 1))
                        spans = [{"first": a, "last": b, "score": s} for a, b, s in found if model.decay * s > chance]
                    out.append({"score": score_of(math.log1p(evidence(words, found, model)), model), "passages": spans})
            yield pa.array(out, judged)

    # only the text goes to Python, and only the verdict comes back
    verdict = free_name(docs, "verdict_")
    rows = docs.select(*[docs[c] for c in kept], judge(text_of(docs, text_column)).alias(verdict))
    return rows.select(*kept, F.col(verdict)["score"].alias(score_name), *([F.col(verdict)["passages"].alias("passages")] if with_passages else []))


def toxicity_model(docs: DataFrame, labels: DataFrame, keep: Column | None = None, most: int = 20_000,
                   id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """Fit on at most ``most`` labelled rows that satisfy ``keep`` (a condition on the labels)."""
    return fit(train_rows(docs, labels, keep, most, id_column, text_column, label_column))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text_column: str = "text", **options) -> DataFrame:
    """The documents that score below the threshold, all columns and rows as they were otherwise."""
    model = toxicity_model(docs, labels, text_column=text_column, **options)
    name = free_name(docs, "toxicity_score")
    return score(docs, model, text_column, docs.columns, score_name=name).where(F.col(name) < threshold).select(*[F.col(c) for c in docs.columns])
