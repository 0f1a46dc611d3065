"""Quality rules: base statistics of every whole text, then robust multivariate outliers.

Each document's statistics become a vector (logarithms of mean word length, symbols, repeated
lines and repeated words in proportion to the words, on an integer grid). For every (language,
source) group the minimum covariance determinant is estimated by concentration steps over all
rows: from each of three deterministic starts, a step keeps the h rows of the smallest Mahalanobis
distance and re-estimates mean and covariance from them, until the kept rows no longer change; of
the cores that the starts end in, the one of least determinant counts. Documents are rejected by
the distance from it.

All estimates are mergeable sums and grid counts: a step is one aggregate over a narrow table of
distinct grid points with a map-side combine, whatever the group's size; no group is gathered
anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, slices, texts_of

WINDOW = 8
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_WHITE = " \t\n\x0b\x0c\r"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words(ids: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Per document, the words that lie in a WINDOW-word window found twice or more in it. ids
    number equal words of a document alike; windows are numbered exactly by doubling (1, 2, 4, 8
    words), so nothing is hashed."""
    pair = np.unique(doc << 32 | ids, return_inverse=True)[1] if len(ids) else ids
    run = 1
    while run < WINDOW and len(pair) > run:
        key = pair[:-run].astype(np.int64) << 32 | pair[run:]
        pair = np.unique(key, return_inverse=True)[1]
        run *= 2
    if run < WINDOW or not len(pair):
        return np.zeros(n, np.int64)
    inside = doc[: len(pair)] == doc[WINDOW - 1 :]
    counts = np.bincount(pair[inside], minlength=int(pair.max()) + 1)
    twice = np.flatnonzero(inside & (counts[pair] > 1))
    mark = np.zeros(len(ids) + 1, np.int64)
    np.add.at(mark, twice, 1)
    np.add.at(mark, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(mark[:-1]) > 0], minlength=n)


def _statistics(texts: list[str]) -> list[np.ndarray]:
    numbers: dict[str, int] = {}
    words, chars, symbols, repeats = [], [], [], []
    ids: list[int] = []
    for text in texts:
        own = text.encode("utf-8", "replace").split()
        words.append(len(own))
        ids += [numbers.setdefault(w, len(numbers)) for w in own]
        chars.append(len(text) - sum(map(text.count, _WHITE)))
        symbols.append(len(_SYMBOLS.findall(text)))
        seen: set[str] = set()
        twice = 0
        for line in text.split("\n"):
            if line.strip(_WHITE):
                twice += line in seen
                seen.add(line)
        repeats.append(twice)
    n = len(texts)
    doc = np.repeat(np.arange(n), words)
    again = _repeated_words(np.array(ids, np.int64), doc, n)
    return [np.asarray(x, np.int64) for x in (words, chars, symbols, repeats, again)]


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds STATISTICS (long) and base_failed (boolean): fewer than 20 words, or over 30% of the
    words in repeated 8-word windows. Null or empty text has zeros and fails. Columns of these
    names are replaced, the others stay except `text` itself. One narrow pass."""
    kept = docs.drop(*STATISTICS, "base_failed")
    fields = [f for f in kept.schema.fields if f.name != text]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in STATISTICS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text):
                made = _statistics(texts_of(rows.column(rows.schema.get_field_index(text))))
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, made)], names=[*(f.name for f in fields), *STATISTICS])

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return kept.mapInArrow(run, schema).withColumn("base_failed", failed)


# --- minimum covariance determinant ---------------------------------------------------------

#: Steps of the logarithmic grid in a unit, so that sums of products are exact integers.
GRID = 256
#: A spread is taken to be this many grid steps at least, by coordinate: statistics that are
#: equal in most documents (no symbols, no repeated line) would otherwise reject every document
#: that has one. At LEVEL, where the core has none and the others are in its centre, a document is
#: rejected alone by about 10 symbols, 3 repeated lines or 12 repeated words per 100 words, or by a
#: mean word length over 9.9 or under 2.3 around 5.
LEAST_SPREAD = (28, 112, 64, 120)
#: Chi-square probability beyond which documents are rejected.
LEVEL = 0.99999
#: Share of a group's rows on which the determinant is minimised.
CORE = 0.75


def vector() -> list[Column]:
    """Grid coordinates: logarithms of the mean word length and of symbols, repeated lines and
    repeated words per 100 words."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = [F.col("word_chars") / words, *(100 * F.col(c) / words for c in STATISTICS[2:])]
    return [F.round(F.log1p(p) * GRID).cast("long") for p in parts]


def _distance(dims: int) -> Column:
    """Squared Mahalanobis distance from the mean m0.. and the inverse covariance p00.. ."""
    gap = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(dims)]
    terms = [F.col(f"p{i}{j}") * gap[i] * gap[j] * (1 if i == j else 2) for i in range(dims) for j in range(i, dims)]
    return reduce(lambda a, b: a + b, terms)


_GROUP = ["_lang", "_source"]
_RUN = [*_GROUP, "_start"]


def _inverse(groups: DataFrame, dims: int, factor: float) -> DataFrame:
    """Rows of groups and starts with means m and covariances c to m, inverse covariances p, and det, the
    logarithm of the covariance's determinant; few rows whatever the number of documents."""
    names = [f"{i}{j}" for i in range(dims) for j in range(i, dims)]
    schema = ", ".join(["_lang string, _source string, _start int", *(f"m{i} double" for i in range(dims)), *(f"p{n} double" for n in names), "det double"])

    def run(batches):
        for rows in batches:
            cov = np.zeros((len(rows), dims, dims))
            for i in range(dims):
                for j in range(i, dims):
                    cov[:, i, j] = cov[:, j, i] = rows[f"c{i}{j}"].fillna(0.0) * factor
            spread = np.maximum(np.sqrt(np.einsum("kii->ki", cov)), np.resize(LEAST_SPREAD, dims))
            half = np.sqrt(np.einsum("kii->ki", cov))
            scale = np.where(half > 0, half, 1.0)
            corr = cov / scale[:, :, None] / scale[:, None, :]
            corr = 0.95 * corr  # keeps the matrix regular where statistics move together
            for i in range(dims):
                corr[:, i, i] = 1.0
            whole = corr * spread[:, :, None] * spread[:, None, :]
            precision = np.linalg.inv(whole) if len(rows) else cov
            out = {**{c: rows[c] for c in _RUN}, **{f"m{i}": rows[f"m{i}"] for i in range(dims)}}
            for i in range(dims):
                for j in range(i, dims):
                    out[f"p{i}{j}"] = precision[:, i, j]
            out["det"] = np.linalg.slogdet(whole)[1] if len(rows) else np.zeros(0)
            yield type(rows)(out)

    return groups.mapInPandas(run, schema)


def _join(points: DataFrame, groups: DataFrame, how: str = "left", keys: list[str] = _GROUP) -> DataFrame:
    """Estimates of a row's group. The group side has a row per (language, source), for each start."""
    side = groups.select(*(F.col(c).alias(f"_g{c}") for c in keys), *(c for c in groups.columns if c not in keys))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in keys))
    return points.join(side, same, how).drop(*(f"_g{c}" for c in keys))


def _moments(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Means m and covariances c of weighted grid points, and _key, a hash of their whole sums."""
    sums = rows.groupBy(*keys).agg(
        F.sum("_w").alias("n"),
        *(F.sum(F.col(f"x{i}") * F.col("_w")).alias(f"s{i}") for i in range(dims)),
        *(F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("_w")).alias(f"q{i}{j}") for i in range(dims) for j in range(i, dims)),
    )
    return sums.select(
        *keys, F.xxhash64("n", *(c for c in sums.columns if c[0] in "sq")).alias("_key"), *((F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(dims)),
        *((F.col(f"q{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))).alias(f"c{i}{j}") for i in range(dims) for j in range(i, dims)),
    )


def _starts(points: DataFrame, dims: int) -> DataFrame:
    """Deterministic first estimates: 0, medians and MADs; 1, mean and covariance of all rows; 2, those
    of the rows within 2.5 robust spreads of the median in every coordinate."""
    medians = materialise(points.groupBy(*_GROUP).agg(*(F.expr(f"percentile(x{i}, 0.5, _w)").alias(f"m{i}") for i in range(dims))))
    robust = materialise(_join(points, medians).groupBy(*_GROUP).agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(dims)),
        *(F.expr(f"pow(1.4826 * percentile(abs(x{i} - m{i}), 0.5, _w), 2)").alias(f"c{i}{i}") for i in range(dims)),
        *(F.lit(0.0).alias(f"c{i}{j}") for i in range(dims) for j in range(i + 1, dims)),
    ))
    near = [F.abs(F.col(f"x{i}") - F.col(f"m{i}")) <= 2.5 * F.greatest(F.sqrt(f"c{i}{i}"), F.lit(float(np.resize(LEAST_SPREAD, dims)[i]))) for i in range(dims)]
    inner = _join(points, robust.select(*_GROUP, *(c for i in range(dims) for c in (f"m{i}", f"c{i}{i}")))).where(reduce(lambda x, y: x & y, near))
    found = [robust, _moments(points, _GROUP, dims).drop("_key"), _moments(inner.select(points.columns), _GROUP, dims).drop("_key")]
    return reduce(DataFrame.unionByName, (df.withColumn("_start", F.lit(k)) for k, df in enumerate(found)))


def fit(points: DataFrame, dims: int, core: float = CORE) -> DataFrame:
    """Estimates (m, p) per group of `points` (_lang, _source, x0..): concentration steps from each of the
    starts; of the cores that they end in the one whose covariance has the least determinant, ties to
    the first start. Deterministic: integer sums and exact percentiles of grid values, whose number
    is bounded by the grid. A run is done when its core's count and sums are those of one of its
    earlier steps (nearly always the last; a core that recurs later would go round for ever), other
    runs go on."""
    xs = [f"x{i}" for i in range(dims)]
    values = [*(f"m{i}" for i in range(dims)), *(f"p{i}{j}" for i in range(dims) for j in range(i, dims))]
    points = materialise(points.groupBy(*_GROUP, *xs).agg(F.count("*").alias("_w")))
    groups = _inverse(_starts(points, dims), dims, 1.0).withColumns({"_seen": F.array().cast("array<bigint>"), "_done": F.lit(False)})
    groups = materialise(groups)
    while not groups.where("not _done").isEmpty():
        open_groups = groups.where("not _done")
        measured = _join(points, open_groups, "inner").withColumn("_d", F.round(F.log1p(_distance(dims)) * GRID).cast("long"))
        limit = measured.groupBy(*_RUN).agg(F.expr(f"percentile(_d, {core}, _w)").alias("_limit"))
        inside = _join(measured.select(*_RUN, *xs, "_w", "_d"), limit, keys=_RUN).where("_d <= ceil(_limit)")
        moments = materialise(_moments(inside, _RUN, dims))
        found = _join(_inverse(moments, dims, consistency(dims, core)), moments.select(*_RUN, "_key"), keys=_RUN)
        found = _join(found, open_groups.select(*_RUN, "_seen"), keys=_RUN)
        found = found.withColumn("_done", F.array_contains("_seen", F.col("_key"))).withColumn("_seen", F.concat("_seen", F.array("_key")))
        before, groups = groups, materialise(found.drop("_key").unionByName(groups.where("_done")))
        discard(before, moments)
    best = groups.groupBy(*_GROUP).agg(F.min_by(F.struct(*values), F.struct(F.round("det", 9), F.col("_start"))).alias("_best"))
    return best.select(*_GROUP, *(F.col(f"_best.{c}").alias(c) for c in values))


def chi_square_quantile(k: int, p: float) -> float:
    """Wilson-Hilferty."""
    z = _normal_quantile(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def consistency(k: int, core: float) -> float:
    """Factor that makes the core's covariance fit a normal distribution's: core / P(chi2 with
    k + 2 degrees <= the core's quantile with k degrees), the probability by Wilson-Hilferty."""
    from statistics import NormalDist

    x = chi_square_quantile(k, core)
    m = k + 2
    inside = NormalDist().cdf(((x / m) ** (1 / 3) - (1 - 2 / (9 * m))) / (2 / (9 * m)) ** 0.5)
    return core / inside


def quality_verdicts(docs: DataFrame, level: float = LEVEL, text: str = "text") -> DataFrame:
    """doc_id, STATISTICS, base_failed, distance (double, null if base_failed) and kept.

    kept is false where base_failed; else it says whether the squared Mahalanobis distance from
    the (language, source) group's robust centre is at most the chi-square quantile `level`.
    Estimates come from all rows that pass the base rules. Null language or source is a value of
    its own; a group of a few rows has the least spreads and keeps what lies within them. Null or
    empty text fails the base rules. Repeated rows stay; extra columns are ignored; an empty
    table gives an empty result.
    """
    dims = 4
    rows = base_statistics(docs.select("doc_id", F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col(text).alias("_text")), "_text")
    rows = materialise(rows.select("*", *(v.alias(f"x{i}") for i, v in enumerate(vector()))))
    groups = fit(rows.where("not base_failed").select(*_GROUP, *(f"x{i}" for i in range(dims))), dims)
    judged = _join(rows, groups).withColumn("distance", F.when(~F.col("base_failed"), _distance(dims)))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= chi_square_quantile(dims, level), F.lit(True)))
    return judged.select("doc_id", *STATISTICS, "base_failed", "distance", kept.alias("kept"))
