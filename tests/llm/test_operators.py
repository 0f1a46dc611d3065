"""Operators on small fixtures: nulls, empty texts and tables, ties, repeated rows, clashing names."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from ledgerlark.llm import chat_format, hilbert_shards, line_dedup, mixing, mtree_search, quality_rules, sentencepiece_codec, toxicity, url_filter
from ledgerlark.llm.queries import tokenizer_path

TEXTS = [None, "", " ", "a", "The the\tquick  brown\nfox", "x" * 3000 + " " * 40 + "yz", "né ▁ 漢字 🙂 end", "same line here\nsame line here\n\nother line of words\r", "word " * 5000, "one two three four five six seven eight " * 6, "# * $ | <> & %"]
DOCS = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3], 0) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", "s1", 0), (None, "same line here", None, "s1", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "<\\\\|im_end|>\\", "<<SYS>><", "", None, "[\\INST][[INST]", "née\r\n\n"]
    rows = [(c, k, ("user", "assistant", "system\n\\x")[(c + k) % 3], random.Random(c * 31 + k).choice(hard) if c else t) for c in range(40) for k, t in enumerate(hard)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(turns).collect()}
    assert found == brute.chats(rows)
    parts = chat_format.format_conversations(turns, part_bytes=64).collect()
    assert len(parts) > 80
    for r in parts:
        for start, size in zip(r["loss_starts"], r["loss_sizes"], strict=True):
            assert not any(c in r["formatted"].encode()[start : start + size].decode() for c in chat_format.Template().controls)
    assert chat_format.digests(turns.limit(0)).count() == 0


def test_chat_long_turns_and_odd_rows(spark):
    """Very long turns, null roles and ids, repeated rows, extra columns; both ways of copying."""
    long = "<|im_end|> née " * 300_000
    rows = [(1, 0, "user", "hi", 5), (1, 1, "assistant", long, 5), (1, 2, "user", "x" * 1025, 5), (2, 0, None, None, 5), (2, 1, "assistant", "y", 5), (2, 1, "assistant", "y", 5)]
    rows += [(3, k, "assistant" if k % 2 else "user", ("z%d " % k) * 400, 5) for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_format.digests(turns).collect()}
    assert found == brute.chats([(c, k, r or "", t) for c, k, r, t, _ in rows])
    nameless = spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    (row,) = chat_format.digests(nameless).collect()
    assert row["conv_id"] is None and row["n_turns"] == 2 and row["loss_chars"] == 1


def test_sentencepiece_equals_the_library(spark, docs, none):
    draw = random.Random(5)
    more = ["".join(draw.choice("abcdehilnorst   éß漢🙂\n.0") for _ in range(400)) for _ in range(60)] + ["a" * 999, " " * 77, "ab" * 500, "\0x\0"]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *more])]
    tokens = sentencepiece_codec.encode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path())
    found = {r["doc_id"]: (r["ids"], r["decoded"]) for r in sentencepiece_codec.decode(tokens, tokenizer_path()).collect()}
    for (i, _), (ids, text) in zip(rows, brute.pieces([t for _, t in rows], tokenizer_path()), strict=True):
        assert found[i] == (ids, text), i
    assert sentencepiece_codec.encode(none, tokenizer_path()).count() == 0
    assert sentencepiece_codec.encode(docs.withColumnRenamed("size", "ids"), tokenizer_path()).columns[-1] == "ids"


def test_sainte_lague_by_highest_quotients():
    draw = np.random.default_rng(3)
    for _ in range(50):
        weights, most = draw.integers(0, 50, 7), draw.integers(0, 40, 7)
        given = np.zeros(7, int)
        for _ in range(60):
            q = np.where((given < most) & (weights > 0), weights / (2 * given + 1), -1)
            if q.max() > 0:
                given[int(np.argmax(q))] += 1
        assert (mixing.sainte_lague(weights, 60, most) == given).all()


def test_mixing_targets_and_limits(spark, docs, none):
    rows = {}
    for r in mixing.mix(docs).collect():
        rows.setdefault((r["doc_id"], r["size"]), []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = {}
    for _, text, _, source, _ in DOCS:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text or ""))
    wanted = brute.targets(sizes)
    by_size = {v: k for k, v in sizes.items()}
    for (r, *_) in rows.values():
        assert abs(r["target"] - wanted[by_size[r["source_size"]]]) < 1e-6
    assert sum(r["taken"] for rs in rows.values() for r in rs) == pytest.approx(sum(sizes.values()), rel=0.01)
    assert mixing.mix(none).count() == 0
    assert set(mixing.mixed_documents(docs).columns) == set(docs.columns)


def test_mixing_meets_targets_where_blocks_exceed_cells(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    monkeypatch.setattr(mixing, "SHARD_ROWS", 10)
    draw = random.Random(6)
    rows = [(i, "big", draw.randrange(1, 400)) for i in range(600)]
    rows += [(1000 + i, "a", draw.randrange(1, 60)) for i in range(90)] + [(2000, "b", 7)] + [(3000 + i, None, draw.randrange(1, 40)) for i in range(60)]
    rows += [(4000 + i, "empty", 0) for i in range(30)]
    found = {}
    for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size int"), size=mixing.F.col("size").cast("long")).collect():
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = next(s for low, s in ((4000, "empty"), (3000, None), (2000, "b"), (1000, "a"), (0, "big")) if r["doc_id"] >= low)
        found.setdefault(source, [r["target"], 0])[1] += r["taken"]
    assert len(found) == 5 and found["a"][0] == 3 * sum(n for _, s, n in rows if s == "a")
    for target, taken in found.values():
        assert abs(taken - target) <= 1


def test_toxicity_learns_and_holds_out(spark, docs, none):
    draw, rows, labels = random.Random(1), [], []
    clean, foul = [f"plain{i}" for i in range(300)], ["vilefool", "rottenscum", "filthyliar"]
    for i in range(400):
        text = draw.choices(clean, k=40)
        if i % 4 == 0:
            text[draw.randrange(40)] = draw.choice(foul)
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = toxicity.verdicts(table, marks).collect()
    assert all(r["held_out"] == brute.held_out(r["doc_id"]) for r in found)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in found if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in found)
    model = toxicity.fit(table, marks)
    spans = toxicity.score(spark.createDataFrame([(1, "née plain1 vilefool, plain2")], "doc_id long, text string"), model).first()
    assert [(a, n) for a, n in zip(spans["tox_starts"], spans["tox_sizes"], strict=True)] == [(11, 8)]
    assert toxicity.score(docs, model).count() == len(DOCS) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, marks.limit(0)).cues == []


def test_field_marginals_and_gradient_by_enumeration():
    from itertools import product

    draw = np.random.default_rng(7)
    model = toxicity.Field(cues=["a", "b"], odds=[2.0, 3.0])
    model.emission, model.transition = draw.normal(size=3), draw.normal(size=(2, 2))
    model.transition[0, 0] = 0.0
    lengths = np.array([1, 4, 6, 3])
    obs, gold = draw.integers(0, 3, lengths.sum()), draw.integers(0, 2, lengths.sum())

    def enumerate_chains(model):
        marginal, pairs, total, likelihood = [], np.zeros((2, 2)), 0.0, 0.0
        for stop, n in zip(np.cumsum(lengths), lengths, strict=True):
            own, said = obs[stop - n : stop], gold[stop - n : stop]
            value = lambda y: sum(model.emission[o] for o, k in zip(own, y, strict=True) if k) + sum(model.transition[a, b] for a, b in zip(y[:-1], y[1:]))
            ways = list(product((0, 1), repeat=int(n)))
            weight = np.exp([value(y) for y in ways])
            total += np.log(weight.sum())
            likelihood += value(tuple(said)) - np.log(weight.sum())
            share = weight / weight.sum()
            marginal += [sum(p for p, y in zip(share, ways, strict=True) if y[t]) for t in range(n)]
            for p, y in zip(share, ways, strict=True):
                for a, b in zip(y[:-1], y[1:]):
                    pairs[a, b] += p
        return np.array(marginal), pairs, total, likelihood

    post, expected, total = model.marginals(lengths, obs, pairs=True)
    marginal, pairs, z, before = enumerate_chains(model)
    assert post == pytest.approx(marginal) and expected == pytest.approx(pairs) and total == pytest.approx(z)
    kind = 1  # the gradient of a weight is its gold count less its expected count
    gradient = gold[obs == kind].sum() - post[obs == kind].sum()
    model.emission[kind] += 1e-5
    assert (enumerate_chains(model)[3] - before) / 1e-5 == pytest.approx(gradient, abs=1e-3)
    # noisy-or of a document's marginals, as log odds; none without a chain
    doc = np.array([0, 0, 2, 2])
    clean = [np.prod(1 - post[:5]), None, np.prod(1 - post[5:])]
    odds = model.evidence(3, doc, lengths, post)
    assert odds[[0, 2]] == pytest.approx([np.log((1 - c) / c) for c in (clean[0], clean[2])]) and np.isneginf(odds[1])


def test_toxicity_finds_rare_words(spark):
    """Words that each stand in under 1 % of the toxic documents (one document in ten) are cues all the same."""
    pick = random.Random(5)
    made = lambda: "".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    plain, vile = [made() for _ in range(400)], [made() for _ in range(130)]
    rows, marks = [], []
    for i in range(9000):
        words = pick.choices(plain, k=30)
        if i % 10 == 0:
            words[pick.randrange(30)] = vile[i // 10 % 130]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 10 == 0)))
    found = toxicity.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = {r["doc_id"]: r["predicted"] for r in found if r["held_out"]}
    learnt = Counter(i // 10 % 130 for i in range(0, 9000, 10) if i not in held)
    taught = [i for i in held if i % 10 == 0 and learnt[i // 10 % 130] >= toxicity.LEAST_DOCS]
    assert len(taught) > 150 and all(held[i] for i in taught)
    assert sum(p for i, p in held.items() if i % 10) <= 0.01 * len(held)


def test_toxicity_of_odd_rows(spark):
    """Reruns agree, repeated rows score alike, columns of the added names are replaced."""
    rows = [(i, f"plain{i % 7} words{i % 5} " + ("vilefool" if i % 3 == 0 else "kind") * 1 + f" rest{i % 11}") for i in range(60)]
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    one, two = toxicity.fit(table, marks), toxicity.fit(table.repartition(5), marks.repartition(3))
    assert one.cues == two.cues and (one.emission == two.emission).all() and one.slope == two.slope
    odd = [(1, "vilefool " * 20_000, 0.1), (1, "vilefool " * 20_000, 0.2), (2, None, 0.3), (3, "", 0.3)]
    found = toxicity.score(spark.createDataFrame(odd, "doc_id long, text string, tox_score double"), one)
    assert found.columns == ["doc_id", "text", "tox_score", "tox_predicted", "tox_starts", "tox_sizes"]
    got = found.collect()
    assert got[0]["tox_score"] == got[1]["tox_score"] > 0.5 and len(got[0]["tox_starts"]) == 20_000
    assert got[2]["tox_score"] == got[3]["tox_score"] < 0.5


def test_models_are_verified_when_loaded(monkeypatch):
    path = tokenizer_path()
    assert sentencepiece_codec.PieceModel(path).size == 32000
    monkeypatch.setattr(sentencepiece_codec, "_SPACE", "_")  # as if the model marked spaces otherwise
    with pytest.raises(ValueError, match="pieces or normaliser"):
        sentencepiece_codec.PieceModel(path)


def test_lines_by_number_of_holders(spark):
    """Counts decide which lines go; null ids, repeated rows, a long text and clashing names besides."""
    often, twice = "held by three documents", "held by two documents"
    rows = [(1, f"{often}\n{twice}"), (2, f"{often}\nown line of two"), (3, f"{often}\n{twice}\n{often}"), (3, f"{often}\n{twice}\n{often}"), (None, f"{often}\nown"), (4, "\n".join(f"line number {k}" for k in range(60_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("own")).withColumn("_cuts", F.lit(7)).repartition(3)
    for holders, want in ((2, {1: 0, 2: 1, 3: 3, None: 1, 4: 0}), (3, {1: 0, 2: 1, 3: 2, None: 1, 4: 0}), (5, dict.fromkeys((1, 2, 3, None, 4), 0))):
        found = line_dedup.dedup_lines(docs, holders=holders).select("doc_id", "n_lines", "n_dropped", "_cuts").collect()
        assert {r["doc_id"]: r["n_dropped"] for r in found} == want and len(found) == 6 and {r["_cuts"] for r in found} == {7}
        assert {r["doc_id"]: r["n_lines"] for r in found}[4] == 60_000


def test_quality_statistics(spark, docs, none):
    found = quality_rules.quality_verdicts(docs).collect()
    assert len(found) == len(DOCS)
    for r in found:
        text = next(t for i, t, *_ in DOCS if i == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.quality(text)
    assert quality_rules.quality_verdicts(none).count() == 0


def test_quality_rejects_outliers(spark):
    draw = random.Random(2)
    rows = [(i, " ".join("w" * draw.randrange(3, 9) + str(i * 100 + j) for j in range(60)), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join("#$%|&<>" * 4 + str(j) for j in range(40)), "en", "s") for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(5))


def test_quality_rejects_by_each_statistic(spark):
    draw, n = random.Random(8), iter(range(10**6))
    prose = lambda k: " ".join("w" * draw.randrange(2, 5) + chr(97 + next(n) % 26) + str(next(n) % 10) for _ in range(k))
    rows = [(i, "\n".join(prose(10) for _ in range(8))) for i in range(300)]
    rows += [(400, " ".join("x" * 15 + str(k) for k in range(60))), (401, " ".join(chr(0x100 + k) for k in range(60)))]  # long and short words
    rows += [(402, prose(60) + " #" * 12 + " " + prose(20))]
    rows += [(403, "".join(f"{prose(7)}\nHome\n" for _ in range(14)))]  # a menu line, no 8-word window twice
    again = " ".join(f"ab{k}c" for k in range(10))
    rows += [(404, f"{prose(60)} {again} {prose(40)} {again} {prose(10)}")]
    rows += [(500, prose(60) + " # " + prose(20)), (501, f"{prose(120)}\nHome\n{prose(30)}\nHome\n{prose(20)}")]  # one of each is usual
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.quality_verdicts(table).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert {i for i, r in found.items() if not r["kept"]} == {400, 401, 402, 403, 404}


def test_quality_core_is_final(spark):
    draw = np.random.default_rng(9)
    rows = [(g, None, *(int(x) for x in point)) for g in ("a", None) for point in draw.multivariate_normal([400, 300], [[9000, 7000], [7000, 9000]], 2000)]
    rows += [("a", None, int(x), int(y)) for x, y in draw.normal([900, 0], 60, (500, 2))]
    points = spark.createDataFrame(rows, "_lang string, _source string, x0 long, x1 long")
    for r in quality_rules.fit(points, 2).collect():
        x = np.array([p[2:] for p in rows if p[0] == r["_lang"]], float)
        gap = x - [r["m0"], r["m1"]]
        d = np.round(np.log1p(r["p00"] * gap[:, 0] ** 2 + r["p11"] * gap[:, 1] ** 2 + 2 * r["p01"] * gap[:, 0] * gap[:, 1]) * quality_rules.GRID)
        assert x[d <= np.ceil(np.quantile(d, quality_rules.CORE))].mean(axis=0) == pytest.approx([r["m0"], r["m1"]], abs=1e-9)


def test_quality_estimate_and_verdict_against_a_plain_version(spark):
    """One group whose median start ends in another core than the least determinant's, and a plain one."""
    draw = np.random.default_rng(7)

    def inverse(cov, factor):
        cov = cov * (quality_rules.consistency(2, quality_rules.CORE) if factor is None else factor)
        half = np.sqrt(np.diag(cov))
        spread, scale = np.maximum(half, quality_rules.LEAST_SPREAD[:2]), np.where(half > 0, half, 1.0)
        corr = 0.95 * cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 1.0)
        whole = corr * np.outer(spread, spread)
        return np.linalg.inv(whole), np.linalg.slogdet(whole)[1]

    for n, apart, width in ((240, 900, 120), (200, 600, 40), (150, 500, 30)):  # the last one
        tilted = np.concatenate([draw.multivariate_normal([0, 0], [[90000, 85000], [85000, 90000]], 700), draw.normal((apart, -apart), width, (n, 2))]).astype(int)
    settings = (tilted.astype(float), quality_rules.CORE, quality_rules.GRID, np.array(quality_rules.LEAST_SPREAD[:2]), inverse)
    assert not np.allclose(brute.robust_estimate(*settings)[0], brute.robust_estimate(*settings, starts=1)[0])
    plain = draw.normal([100, 300], [150, 250], (500, 2)).astype(int)
    rows = [(g, "s", int(a), int(b)) for g, x in (("t", tilted), (None, plain)) for a, b in x]
    found = {r["_lang"]: r for r in quality_rules.fit(spark.createDataFrame(rows, "_lang string, _source string, x0 long, x1 long").repartition(3), 2).collect()}
    for g, x in (("t", tilted), (None, plain)):
        mean, p = brute.robust_estimate(x.astype(float), quality_rules.CORE, quality_rules.GRID, np.array(quality_rules.LEAST_SPREAD[:2]), inverse)
        r = found[g]
        assert [r["m0"], r["m1"]] == pytest.approx(mean.tolist(), abs=1e-9) and [r["p00"], r["p01"], r["p11"]] == pytest.approx([p[0, 0], p[0, 1], p[1, 1]], rel=1e-9)


@pytest.mark.parametrize("clustered", [False, True])
def test_top_k_against_all(spark, monkeypatch, clustered):
    monkeypatch.setattr(mtree_search, "PAGE_ROWS", 8)
    monkeypatch.setattr(mtree_search, "PAGE_QUERIES", 3)
    monkeypatch.setattr(mtree_search, "_SENT_BYTES", 500)
    monkeypatch.setattr(mtree_search, "_KEPT_ROWS", 40)
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(20, 6)) * (5 if clustered else 0)
    rows = [(i, [float(x) for x in draw.normal(size=6) + centres[i % 20]], 0) for i in range(400)] + [(1000 + i, [0.5] * 6, 0) for i in range(60)]
    rows += [(5000, None, 0), (5050, [None] * 6, 0), (5100, [float("nan")] * 6, 0), (5150, [float("inf")] * 6, 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, page int")
    found, computed = {}, {}
    for r in mtree_search.top_k(vectors, vectors.where("vec_id % 50 = 0")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        computed[r["query_id"]] = r["n_computed"]
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:460]}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(found.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not found
    if clustered:
        assert sum(computed.values()) < 0.6 * 460 * len(computed)
    assert mtree_search.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_hilbert_curve_and_shards(spark, docs, none):
    from pyspark.sql import functions as F

    cells = spark.range(4096).select((F.col("id") % 16).alias("x"), (F.floor(F.col("id") / 16) % 16).alias("y"), F.floor(F.col("id") / 256).alias("z"))
    path = cells.select("x", "y", "z", hilbert_shards.hilbert_index([F.col(c) for c in "xyz"], 4).alias("h")).orderBy("h").collect()
    assert [r["h"] for r in path] == list(range(4096))
    assert all(abs(a["x"] - b["x"]) + abs(a["y"] - b["y"]) + abs(a["z"] - b["z"]) == 1 for a, b in zip(path, path[1:]))
    rows = hilbert_shards.shard_documents(docs, 4).collect()
    slots = sorted((r["shard"], r["slot"]) for r in rows)
    counts = [sum(s == k for s, _ in slots) for k in range(4)]
    assert max(counts) - min(counts) <= 1 and slots == [(k, j) for k in range(4) for j in range(counts[k])]
    assert hilbert_shards.shard_documents(none).count() == 0


def test_hilbert_shards_keep_groups_and_prune(spark, tmp_path):
    import zlib

    draw = random.Random(3)
    rows = [(i, "w " * draw.choice((3, 30, 300, 3000)) + str(i), draw.choice(("de", "en", "fr", None)), f"s{draw.randrange(12)}", i) for i in range(2000)]
    rows += [(5000 + i, f"same {i % 40}", draw.choice(("de", "en")), f"s{draw.randrange(12)}", 0) for i in range(400)]  # equal texts of several cells
    docs = spark.createDataFrame(rows, SCHEMA)
    placed = hilbert_shards.shard_documents(docs, 16).collect()
    text = {r[0]: r[1] for r in rows}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 16, zlib.crc32(text[r["doc_id"]].encode())) for r in placed)
    where = {}
    for r in placed:
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    cut = [w for w in where.values() if len(w) > 1]
    assert len(cut) < 16 and all(len(w) == 2 for w in cut)  # only at edges
    order = sorted(placed, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in order)
    hilbert_shards.write_shards(docs, str(tmp_path / "out"), 16)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows) and {"text", "lang", "source", "shard"} <= set(out.columns)
    spans = {c: [(r["a"], r["b"]) for r in out.groupBy("shard").agg(hilbert_shards.F.min(c).alias("a"), hilbert_shards.F.max(c).alias("b")).collect()] for c in ("lang_code", "source_code", "size_code")}
    for c in spans:  # a scan for one value skips shards by their minima and maxima
        values = [r[0] for r in out.select(c).distinct().collect()]
        met = sum(a <= v <= b for v in values for a, b in spans[c]) / len(values)
        assert met <= 10, (c, met, spans[c])


def test_cascade_is_exact(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(keys.where("hash(key) % 7 = 0"), keys.union(keys))
    wrong = keys.where(cascade.contains(keys["key"]) != (keys["key"].isNotNull() & (url_filter.F.hash("key") % 7 == 0)))
    assert len(cascade.levels) > 1 and wrong.count() == 0


def test_url_rules(spark):
    urls = ["https://a.example.ORG/es/x", "http://example.org/en/12?q", "http://notexample.org/es/", "x://com/fr/a", "x://b.com/de/#y", "x://b.com/de", None, "no scheme", "x://free-bets.net/", "x://"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.listed_by_label(pages)).collect()}
    assert found == {0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("org/", "allow"), 3: ("com/fr/", "allow"), 4: ("com/de/", "block"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: (None, "allow")}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 50, 5000):
        keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        assert sorted(line_dedup.perfect_slots(line_dedup.build_perfect_hash(keys), n, keys).tolist()) == list(range(n))


def test_line_dedup(spark, none):
    draw = random.Random(4)
    lines = [" Shared line NUMBER %d\t" % i for i in range(30)] + ["short", "", "ÀÉ long enough", "àé long enough"]
    rows = [(i, "\n".join(draw.choices(lines, k=9) + [f"own line of {i} alone"])) for i in range(60)] + [(100, None), (101, ""), (102, "shared LINE number 3")]
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == brute.line_dedup(rows)
    assert line_dedup.dedup_lines(none).count() == 0
