"""BPE codec, Merkle manifest and importance resampling against plain versions."""

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import bpe_codec, importance, merkle, queries
from ledgerlark.llm.common import placed, table


SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
ODD = [
    None, "", " ", "\n\n", "a", "Hello, WORLD's 123 it's we'll", "<|endoftext|>a<|startoftext|>", "<|endoftext", "ΣΑΣ Σ İstanbul ẞ ß", "é ẛ̣ ﬁ", "中文 한국 가 😀👍🏽",
    "x" * 4000, "ab" * 3000, "\x00\x1c\x85​﻿ z", "ꟋᲉ\U00016ea0 ՘ ₝", "’s “q” — … €5", "'S 'LL ''s", "tab\tand\x0bfeed\x0c \xa0 end",
]


def documents(spark, rows):
    return spark.createDataFrame(rows, DOCS)


# --- BPE ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_librarys(spark, name):
    draw = random.Random(3)
    letters = "abcAB 12'sSİÉßΣς́̇ 中한😀\n\t!?#*’—" + "<|endoftext|>"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(300)]
    texts += ["".join(chr(draw.randrange(0x20, 0x3000)) for _ in range(40)) for _ in range(200)] + ["the quick brown fox " * 80_000]
    path = queries.tokenizer_path(name)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("decoded", F.lit("own")).repartition(4)
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe_codec.decode(bpe_codec.encode(docs, path), path).collect()}
    assert [got[i] for i in range(len(texts))] == brute.word_tokens(texts, path)


def test_bpe_query_and_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    want = {}
    for (doc_id, _), (ids, back) in zip(rows, brute.word_tokens([t for _, t in rows], queries.tokenizer_path(queries.WORD_MODEL)), strict=True):
        want[doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(back))
    assert {r[0]: tuple(r)[1:] for r in queries.op11_bpe(spark, SF).collect()} == want
    twice = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string").withColumn("ids", F.lit("own")).withColumn("packed", F.lit(1))
    found = bpe_codec.digests(twice, queries.tokenizer_path(queries.WORD_MODEL)).orderBy(F.desc("n_tokens")).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in found] == [(None, 2), (1, 0), (1, 0)] and found[1]["decoded_sha256"] == brute.sha("")
    assert bpe_codec.digests(twice.limit(0), queries.tokenizer_path(queries.WORD_MODEL)).count() == 0


def test_stale_entries_are_skipped():
    model = bpe_codec.MergeModel.load(queries.tokenizer_path(queries.WORD_MODEL))

    def plain(word):  # one merge at a time over the whole list
        s = [model.vocabulary[x] for x in word[:-1]] + [model.vocabulary[word[-1] + model.suffix]]
        while ranks := [(model.pairs[k], i) for i in range(len(s) - 1) if (k := s[i] << 24 | s[i + 1]) in model.pairs]:
            (_, made), i = min(ranks)
            s[i : i + 2] = [made]
        return s

    draw = random.Random(5)
    for _ in range(300):
        word = model.lettered("".join(draw.choice("aeinrst") for _ in range(draw.randrange(1, 40))))
        assert model.merge(word) == plain(word)


def test_other_tokenizer_files_are_refused(tmp_path):
    path = tmp_path / "unigram.json"
    path.write_text('{"version": "1.0", "model": {"type": "Unigram", "vocab": [["a", 0.0]]}, "added_tokens": []}')
    with pytest.raises(ValueError, match="plain BPE"):
        bpe_codec.MergeModel(str(path))


# --- manifest -------------------------------------------------------------------------------


def drawn_documents(n=400):
    """Rows of a hot source, a null one, lone ones; null fields, repeated rows, equal keys."""
    draw = random.Random(9)
    rows = []
    for i in range(n):
        source = draw.choice(["hot", "hot", "hot", "a", "é", "Z", None, "", f"lone{i}" if i % 9 == 0 else "b"])
        rows.append((i, source, draw.choice(["en", None]), draw.choice([i, None]), draw.choice([None, "", "one line", "two\nlines", "é\n\n中" * 3])))
    return rows + rows[:3] + [(5, "hot", "en", 1, "other"), (None, "hot", None, None, None), (None, "hot", None, None, None), (10_001, "hot", "en", 1, "long\n" * 200_000)]


def manifest_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"levels": 1}, {"levels": 2, "most": 1}, {"levels": 1, "most": 3}, {"levels": 3, "most": 12}])
def test_proofs_whatever_the_blocks(spark, options):
    rows = drawn_documents()
    docs = documents(spark, rows).repartition(5)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    text = F.when(hit, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.prove(docs, claimed={"text": text}, **options)
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("siblings").cast("binary"), 256).alias("p"), "folded_root", (F.col("folded_root") == F.col("root")).alias("v"))
    assert manifest_rows(got) == brute.merkle(rows)


def test_manifest_query_and_edges(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents", *merkle.FIELDS).collect()]
    got = manifest_rows(queries.op12_merkle(spark, SF))
    assert got == brute.merkle(rows) and {r[-1] for r in got} == {True, False}
    one = [(7, "only", None, None, "a\nb")]
    docs = documents(spark, one).withColumn("leaf", F.lit(1)).withColumn("root", F.lit("own")).withColumn("_pos", F.lit(2))
    (row,) = merkle.digests(docs).collect()
    assert tuple(row) == brute.merkle(one)[0] and row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == brute.sha("")
    assert merkle.digests(docs.limit(0)).count() == 0
    whole = {r["source"]: (r["n_rows"], r["subroot"]) for r in merkle.manifest(documents(spark, drawn_documents())).collect()}
    assert whole[None][0] == sum(r[1] is None for r in drawn_documents()) and "" in whole


def test_a_proof_is_bound_to_its_place(spark):
    docs = documents(spark, drawn_documents(60))
    rows = merkle.prove(docs).collect()
    assert all(merkle.fold(r["leaf"], r["places"], r["siblings"]) == r["root"] == r["folded_root"] for r in rows)
    first = rows[0]
    other = next(r for r in rows if r["leaf"] != first["leaf"])
    assert merkle.fold(other["leaf"], first["places"], first["siblings"]) != first["root"]
    with pytest.raises(ValueError, match="arity"):
        merkle.prove(docs, arity=10)


def test_places_are_gapless_in_hot_groups(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), (F.col("id") % 50).alias("k")).repartition(6)
    got = placed(rows, [F.desc("k")], "place", "g", "n").collect()
    by = {}
    for r in got:
        by.setdefault(r["g"], []).append((r["place"], -r["k"], r["n"]))
    for found in by.values():
        found.sort()
        assert [p for p, _, _ in found] == list(range(len(found))) and {n for _, _, n in found} == {len(found)}
        assert [k for _, k, _ in found] == sorted(k for _, k, _ in found)


# --- resampling -----------------------------------------------------------------------------


def texts(n=300):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "é", "ΑΒ", "don't", "a-b", "X9", "中文"]
    return [" ".join(draw.choice(words[: draw.choice([5, 30, 67])]) for _ in range(draw.choice([0, 3, 19, 20, 21, 60]))) for _ in range(n)]


@pytest.mark.parametrize(("longest", "buckets"), [(1, 10_000), (2, 50), (3, 10_000)])
def test_weights_scores_and_draws(spark, longest, buckets):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "w1 " * 30), (None, "w1 " * 30), (900, None), (901, ""), (902, "!!! ..."), (903, "long w2 " * 100_000), (5, texts()[5]), (5, texts()[5])]
    target = ["w1 w2 w3 é", None, "", "w1 w1 w2 X9 " * 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, aims, longest=longest, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute.importance(rows, target, longest, buckets)


def test_resampling_query_and_edges(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    target = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    assert sorted((tuple(r) for r in queries.op13_importance(spark, SF).collect()), key=str) == brute.importance(rows, target)
    docs = table(spark, SF, "documents", "doc_id", "text")
    assert importance.verdicts(docs.limit(0), table(spark, SF, "benchmark", "text")).count() == 0
    few = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    assert sorted((tuple(r) for r in importance.verdicts(few, few.limit(0)).collect()), key=str) == brute.importance([(1, "a b c " * 10), (2, None)], [])


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    seen = []
    crc = importance.zlib.crc32
    monkeypatch.setattr(importance.zlib, "crc32", lambda b: seen.append(b) or crc(b))
    hasher = importance.FeatureHasher(2, 1000)
    owner, bucket, sizes = hasher.features(["a b a b a", "b a", ""])
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"] and sizes.tolist() == [5, 2, 0] and len(bucket) == 5 + 4 + 2 + 1
    hasher.features(["a b"])
    assert seen.count(b"a") == 1
