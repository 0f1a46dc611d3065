"""The pipeline's stages and run() against plain versions, on a small folder of tables."""

import random
from collections import Counter

import brute
import corpus_pipeline
import pytest
from ledgerlark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOUL = ("vilefool", "rottenscum", "filthyliar")


def made() -> tuple[list[tuple], list[tuple]]:
    draw = random.Random(11)
    words = [f"plain{i}" for i in range(400)]
    texts: dict[int, str | None] = {}
    for i in range(240):
        text = draw.choices(words, k=60)
        if i % 4 == 0:
            text[draw.randrange(60)] = draw.choice(FOUL)
        texts[i] = " ".join(text[:30]) + ("\nA shared footer line" if i % 5 == 1 else "\nown") + f" \n{' '.join(text[30:])}"
    for i in range(300, 330):  # near copies
        texts[i] = texts[i - 299].replace("plain7", "plain8", 1)
    texts |= {400: None, 401: "", 402: "A SHARED footer line", 403: " \t", 404: texts[1], 405: "one two"}
    rows = [(i, t, ("en", None, "de")[i % 3], ("s1", "s2", "s3", None)[i % 4 if i > 9 else 0], None if t is None else len(t)) for i, t in texts.items()]
    return rows + [rows[7]], [(i, int(i % 4 == 0)) for i in range(240)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, labels = made()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def after(spark, folder, k: int) -> list:
    """Rows of the first k stages, written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:k]:
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, folder))
        assert docs.columns == columns or k == 5
    return docs.collect()


def test_stages_and_run(spark, folder):
    rows, _ = made()
    steps = [[tuple(r) for r in after(spark, folder, k)] for k in range(1, 6)]
    toxic = {i for i, t, *_ in rows if any(f in (t or "") for f in FOUL)}
    assert Counter(steps[0]) == Counter(r for r in rows if r[0] not in toxic)
    # lines
    kept = brute.line_dedup([r[:2] for r in steps[0]])
    want = [(i, kept[i][2], lang, source, len(kept[i][2])) for i, _, lang, source, _ in steps[0]]
    assert Counter(steps[1]) == Counter(want) and any(r[1] == "" and r[0] == 402 for r in want)
    # near duplicates
    found = brute.near_duplicates([r[:2] for r in steps[1]])
    assert Counter(steps[2]) == Counter(r for r in steps[1] if found[r[0]][1] == r[0])
    # mix: whole documents, near the targets, at most three times each (a repeated row once more)
    sizes: Counter = Counter()
    for r in steps[2]:
        sizes[r[3]] += len(brute.WORD.findall(r[1] or ""))
    wanted, taken = brute.targets(sizes), Counter()
    most = max(len(brute.WORD.findall(r[1] or "")) for r in steps[2])
    for r, n in Counter(steps[3]).items():
        assert r in steps[2] and n <= 3 * steps[2].count(r)
        taken[r[3]] += n * len(brute.WORD.findall(r[1]))
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 2 * most, source
    # tokens
    ids = [i for i, _ in brute.pieces([r[1] for r in steps[3]], tokenizer_path())]
    assert Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in steps[4]) == Counter((r[0], r[2], r[3], len(i), tuple(i)) for r, i in zip(steps[3], ids, strict=True))
    assert Counter((r[0], tuple(r[4])) for r in corpus_pipeline.run(spark, folder).collect()) == Counter((r[0], tuple(r[4])) for r in steps[4])


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
