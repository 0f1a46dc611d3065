"""Toxicity by a linear-chain conditional random field over tokens.

1. From a bounded sample of labelled documents, cues are found: words, and prefixes of words,
   whose document frequency among toxic documents is far above that among the others (counted
   by a Spark aggregate). They label the sample's tokens: a token with a cue is toxic in a toxic
   document; every other token is clean.
2. Chains are runs of tokens around cues. The field (two states, a weight for each cue and for
   plain tokens, transitions) is fitted to the labelled chains by its exact gradient.
3. Every whole text is tagged: forward-backward marginals give each token's probability. A
   document's score is the calibrated noisy-or of its marginals; spans are its tagged tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices, texts_of

_TOKEN = re.compile(r"\w+")
#: Labelled documents that the fit takes at most (the first in hash order of doc_id).
SAMPLE_DOCS = 12_000
#: Lengths of the prefixes that can be cues.
PREFIXES = (4, 5, 6, 7, 8)
#: A cue's least number of toxic documents and its least log odds against the sample's own rate,
#: alike at every sample size. The odds are smoothed by PRIOR_DOCS documents at that rate, so words
#: of a few documents must stand in toxic ones only.
LEAST_DOCS, LEAST_ODDS, PRIOR_DOCS = 3, 2.5, 2.0
#: Cues kept at most (the highest odds, then by code point), which bounds what the driver collects
#: and each task gets. Part of the fit on the bounded sample, not of the scoring.
MAX_CUES = 50_000
#: Tokens of context on either side of a cue, and tokens of a chain at most (a longer run of cues
#: goes on in another chain).
CONTEXT, CHAIN = 5, 256
_CACHED_WORDS = 400_000


class _Cues(dict):
    """Word -> number of its strongest cue (0: none), filled as words come up."""

    def __init__(self, numbers: dict[str, int], odds: np.ndarray):
        super().__init__()
        self.numbers, self.odds = numbers, odds

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHED_WORDS:
            self.clear()
        low = word.lower()
        best = self.numbers.get(low, 0)
        for n in PREFIXES:
            if n >= len(low):
                break
            cue = self.numbers.get(low[:n] + "*", 0)
            if cue and (not best or self.odds[cue] > self.odds[best]):
                best = cue
        self[word] = best
        return best


def _features(text: str) -> set[str]:
    words = set(map(str.lower, set(_TOKEN.findall(text))))
    return words | {w[:n] + "*" for w in words for n in PREFIXES if n < len(w)}


def _chains(texts: list[str], cues: _Cues) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chains of all texts: document, first token (place in the document), length, and the
    observations (cue numbers) of all chains one after another."""
    tokens = [_TOKEN.findall(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.fromiter((cues[w] for t in tokens for w in t), np.int32, int(sizes.sum()))
    stops = np.cumsum(sizes)
    at = np.flatnonzero(flat)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int32),)
    doc = np.searchsorted(stops, at, side="right")
    apart = np.concatenate([[True], (np.diff(at) > 2 * CONTEXT) | (np.diff(doc) != 0)])
    opens = np.flatnonzero(apart)
    first, last, doc = at[opens], at[np.append(opens[1:], len(at)) - 1], doc[opens]
    low, high = np.maximum(first - CONTEXT, (stops - sizes)[doc]), np.minimum(last + CONTEXT + 1, stops[doc])
    pieces = -(-(high - low) // CHAIN)
    index = np.repeat(np.arange(len(low)), pieces)
    nth = np.arange(len(index)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = low[index] + nth * CHAIN
    length = np.minimum(start + CHAIN, high[index]) - start
    doc = doc[index]
    where = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return doc, start - (stops - sizes)[doc], length, flat[where]


@dataclass
class Field:
    """Weights: plain and cue observations in the toxic state, transitions between the states
    (clean-clean is 0), and the calibration of document scores."""

    cues: list[str] = field(default_factory=list)
    odds: list[float] = field(default_factory=list)
    emission: np.ndarray = field(default_factory=lambda: np.zeros(1))
    transition: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    offset: float = 0.0
    none: float = 0.0  # score of a document without cues

    def lookup(self) -> _Cues:
        return _Cues({c: i + 1 for i, c in enumerate(self.cues)}, np.array([0.0, *self.odds]))

    def marginals(self, lengths: np.ndarray, obs: np.ndarray, pairs: bool = False):
        """Toxic marginals of all chains one after another; with pairs also the expected
        transition counts. Chains of similar length are computed together."""
        out = np.zeros(len(obs))
        expected, total = np.zeros((2, 2)), 0.0
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        step = 2048
        for begin in range(0, len(order), step):
            rows = order[begin : begin + step]
            n, width = lengths[rows], int(lengths[rows].max())
            inside = np.arange(width)[None, :] < n[:, None]
            cell = np.minimum(starts[rows][:, None] + np.arange(width)[None, :], len(obs) - 1)
            score = np.zeros((len(rows), width, 2))
            score[:, :, 1] = np.where(inside, self.emission[obs[cell]], 0.0)
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for t in range(1, width):
                step_in = np.logaddexp.reduce(alpha[:, t - 1][:, :, None] + self.transition[None], axis=1) + score[:, t]
                alpha[:, t] = np.where(inside[:, t, None], step_in, alpha[:, t - 1])
            z = np.logaddexp.reduce(alpha[:, -1], axis=1)
            for t in range(width - 2, -1, -1):
                step_out = np.logaddexp.reduce(self.transition[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(inside[:, t + 1, None], step_out, 0.0)
            post = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
            out[cell[inside]] = post[inside]
            if pairs:
                total += float(z.sum())
                joint = alpha[:, :-1, :, None] + self.transition[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
                expected += (np.exp(np.minimum(joint, 0.0)) * inside[:, 1:, None, None]).sum((0, 1))
        return (out, expected, total) if pairs else out

    def learn(self, lengths: np.ndarray, obs: np.ndarray, gold: np.ndarray, steps: int = 120, ridge: float = 0.5) -> None:
        """Regularised maximum likelihood by sign-based gradient steps (Rprop) on the exact
        gradient: gold counts less expected counts."""
        kinds = len(self.cues) + 1
        self.emission = np.concatenate([[-1.0], np.array(self.odds)])
        self.transition = np.array([[0.0, -1.0], [-1.0, 0.0]])
        prior = np.concatenate([self.emission, self.transition.ravel()])
        ends = np.cumsum(lengths) - 1
        follows = np.ones(len(obs), bool)
        follows[ends] = False
        at = np.flatnonzero(follows)
        seen = np.bincount(gold[at] * 2 + gold[at + 1], minlength=4).astype(float)
        held = np.bincount(obs, weights=gold, minlength=kinds)
        size, last = np.full(kinds + 4, 0.2), np.zeros(kinds + 4)
        for _ in range(steps):
            post, expected, _ = self.marginals(lengths, obs, pairs=True)
            gradient = np.concatenate([held - np.bincount(obs, weights=post, minlength=kinds), seen - expected.ravel()])
            gradient -= ridge * (np.concatenate([self.emission, self.transition.ravel()]) - prior)
            gradient[kinds] = 0.0  # clean-clean stays 0
            turn = gradient * last
            size = np.clip(np.where(turn > 0, size * 1.2, np.where(turn < 0, size * 0.5, size)), 1e-4, 1.0)
            gradient = np.where(turn < 0, 0.0, gradient)
            move = np.sign(gradient) * size
            self.emission = self.emission + move[:kinds]
            self.transition = self.transition + move[kinds:].reshape(2, 2)
            last = gradient

    def evidence(self, n: int, doc: np.ndarray, lengths: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Log odds of the noisy-or of a document's marginals (-inf: no cue)."""
        token_doc = np.repeat(doc, lengths)
        clean = np.bincount(token_doc, weights=np.log1p(-np.minimum(post, 1 - 1e-9)), minlength=n)
        clean = np.minimum(clean, -1e-9)
        odds = np.log(-np.expm1(clean)) - clean
        return np.where(np.bincount(doc, minlength=n) > 0, odds, -np.inf)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            z = np.clip(self.offset + self.slope * np.clip(evidence, -30, 30), -500, 500)
        return np.where(np.isneginf(evidence), self.none, 1 / (1 + np.exp(-z)))


def _calibrate(evidence: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset of a ridge logistic fit over documents with cues; share of toxic ones
    among those without."""
    has = ~np.isneginf(evidence)
    none = (label[~has].sum() + 0.5) / ((~has).sum() + 2.0)
    x, y = np.clip(evidence[has], -30, 30), label[has].astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(50 if len(x) else 0):
        p = 1 / (1 + np.exp(-(offset + slope * x)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((y - p) * x).sum() - (slope - 1.0), (y - p).sum() - 0.1 * offset])
        h = np.array([[(w * x * x).sum() + 1.0, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(d[0], -0.5, 0.5)), offset + float(np.clip(d[1], -2, 2))
    return max(slope, 0.05), offset, min(none, 0.49)


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE_DOCS) -> Field:
    """Fit on the first `sample` labelled rows in hash order that aren't held out (labels:
    doc_id, toxic; a repeated label counts as toxic if any says so, null is no label). Copies
    among them (same two smallest hashes of three-word runs) count once. The cue counts are a
    Spark aggregate; the driver gets cues and the sample's chains only."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    known = known.where(~F.coalesce(held_out(F.col("_id")), F.lit(True)))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "_toxic", "_text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for text in texts_of(batch.column(2)):
                words = text.lower().split()
                runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
                low = sorted(map(xxhash.xxh64_intdigest, runs))[:2]
                marks.append("-".join(map(str, low)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=["doc_id", "_toxic", "_text", "_mark"])

    rows = rows.mapInArrow(signed, "doc_id long, _toxic int, _text string, _mark string")
    first = rows.groupBy("_mark", "_toxic").agg(F.min(F.struct("doc_id", "_text")).alias("_row"))  # the smallest doc_id, so reruns agree
    rows = materialise(first.select("_row.doc_id", "_toxic", "_row._text"))
    counts = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    if not bad or not good:
        share = float(bad > 0)
        return Field(none=share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for toxic, text in zip(batch.column(1).to_pylist(), texts_of(batch.column(2)), strict=True):
                own = tally[toxic]
                for f in _features(text):
                    own[f] = own.get(f, 0) + 1
            for toxic in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(tally[toxic].keys(), pa.string()), pa.array([toxic] * len(tally[toxic]), pa.int32()), pa.array(tally[toxic].values(), pa.int64())], names=["feature", "toxic", "n"])

    tallied = rows.mapInArrow(count, "feature string, toxic int, n long").groupBy("feature")
    tallied = tallied.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    rate = bad / (bad + good)
    smooth = (F.col("bad") + PRIOR_DOCS * rate) / (F.col("good") + PRIOR_DOCS * (1 - rate))
    tallied = tallied.withColumn("odds", F.log(smooth * (good / bad)))
    strong = tallied.where((F.col("bad") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    found = sorted(strong.orderBy(F.desc("odds"), "feature").limit(MAX_CUES).collect(), key=lambda r: r["feature"])
    model = Field(cues=[r["feature"] for r in found], odds=[r["odds"] for r in found])
    if not model.cues:
        model.none = (bad + 0.5) / (bad + good + 1)
        return model
    lists = (model.cues, model.odds)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = Field(*lists).lookup()
        for batch in batches:
            doc, _, length, obs = _chains(texts_of(batch.column(2)), cues)
            ends = np.cumsum(length)
            cut = [b""] * batch.num_rows
            sizes = [b""] * batch.num_rows
            for d in np.unique(doc).tolist():
                own = np.flatnonzero(doc == d)
                cut[d] = obs[ends[own[0]] - length[own[0]] : ends[own[-1]]].tobytes()
                sizes[d] = length[own].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.binary()), pa.array(cut, pa.binary())], names=["doc_id", "toxic", "sizes", "obs"])

    sample_rows = rows.mapInArrow(gather, "doc_id long, toxic int, sizes binary, obs binary").orderBy("doc_id").collect()
    label = np.array([r["toxic"] for r in sample_rows])
    sizes = [np.frombuffer(r["sizes"], np.int64) for r in sample_rows]
    lengths = np.concatenate(sizes)
    doc = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
    obs = np.concatenate([np.frombuffer(r["obs"], np.int32) for r in sample_rows])
    gold = ((obs > 0) & (label[np.repeat(doc, lengths)] == 1)).astype(np.int64)
    model.learn(lengths, obs, gold)
    evidence = model.evidence(len(label), doc, lengths, model.marginals(lengths, obs))
    model.slope, model.offset, model.none = _calibrate(evidence, label)
    return model


def score(docs: DataFrame, model: Field, text: str = "text", spans: bool = True) -> DataFrame:
    """Adds tox_score (double), tox_predicted (int) and, with spans, tox_starts / tox_sizes
    (array<int>, code points of the whole text): the tokens with a marginal of 0.5 or more.

    Null or empty text scores like any text without cues; very long texts are tagged whole, in
    chains of CHAIN tokens at most. Input columns of these names are replaced, all others stay; repeated rows score alike; an empty table stays empty. One narrow
    pass over whole texts."""
    made = [T.StructField("tox_score", T.DoubleType()), T.StructField("tox_predicted", T.IntegerType())]
    made += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("tox_starts", "tox_sizes")] * spans
    kept = docs.drop("tox_score", "tox_predicted", "tox_starts", "tox_sizes")
    names = [*kept.columns, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = model.lookup()
        for batch in batches:
            for rows in slices(batch, text):
                texts = texts_of(rows.column(rows.schema.get_field_index(text)))
                doc, first, length, obs = _chains(texts, cues)
                post = model.marginals(length, obs)
                scores = model.scores(model.evidence(len(texts), doc, length, post))
                out = [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                if spans:
                    where = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(len(obs))
                    hit = np.flatnonzero(post >= 0.5)
                    by_doc: dict[int, list[int]] = {}
                    for d, t in zip(np.repeat(doc, length)[hit].tolist(), where[hit].tolist(), strict=True):
                        by_doc.setdefault(d, []).append(t)
                    starts: list[list[int]] = [[] for _ in texts]
                    sizes: list[list[int]] = [[] for _ in texts]
                    for d, tokens in by_doc.items():
                        wanted = set(tokens)
                        for i, m in enumerate(_TOKEN.finditer(texts[d])):
                            if i in wanted:
                                starts[d].append(m.start())
                                sizes[d].append(m.end() - m.start())
                    out += [pa.array(starts, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *out], names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *made]))


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, n_spans besides."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"),
        F.col("tox_predicted").alias("predicted"), F.size("tox_starts").cast("long").alias("n_spans"),
    )
