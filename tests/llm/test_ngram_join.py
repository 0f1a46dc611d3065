import random

import brute
import pytest
from ledgerlark.llm import ngram_join

SCHEMA = "doc_id long, text string"


def held_against_brute(spark, rows):
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.near_duplicates(rows)


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10_000)}" for _ in range(n)]


def test_families_edges_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "a b c d e f g h i j"), (8, "A b c d e f g h i j k"), (9, " ")]
    for family in range(4):
        base = words(60 + 80 * family, family)
        for k in range(12):  # ever farther from the first, near to the one before
            rows.append((100 * family + 100 + k, " ".join(base)))
            base = base[:]
            base[(7 * k) % len(base)] = f"x{k}"
    passage = words(80, 99)
    rows += [(1000 + k, " ".join(passage + words(20 + k, 200 + k))) for k in range(12)]
    held_against_brute(spark, rows)


def test_blocks_of_a_large_family(spark, monkeypatch):
    """Many near copies in several components, with blocks of a few members."""
    monkeypatch.setattr(ngram_join, "GROUP", 5)
    base, rows = words(100, 1), []
    for k in range(60):
        text = base[:]
        for j in range(3 + k % 3):
            text[(11 * k + 17 * j) % 100] = f"y{k}-{j}"
        rows.append((k, " ".join(text)))
    held_against_brute(spark, rows)


def test_repeated_ids_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5), (1, "p q r s t u", 5), (2, "a b c d e f", 6), (3, "p q r s t u", 6), (None, "a b c d e f", 7)], "doc_id long, text string, n int")
    found = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, None)}
    assert sorted((r["doc_id"] or 0) for r in ngram_join.one_of_each(docs).collect()) == [0, 1, 1]


def test_empty_table(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n, m, least", [(5, 5, 5), (10, 10, 9), (9, 10, 9), (100, 80, 80)])
def test_overlap(n, m, least):
    assert ngram_join.overlap(n, m) == least


def test_forest_spans_the_components_with_fewer_links_than_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    for size in (1, 2, 40):
        for count in (0, 1, 30, 600):
            i, j = rng.integers(0, size, count), rng.integers(0, size, count)

            def labels(a, b, size=size):
                root = list(range(size))
                for _ in range(size):
                    for x, y in zip(a.tolist(), b.tolist(), strict=True):
                        root[x] = root[y] = min(root[x], root[y])
                return root

            a, b = ngram_join._forest(size, i, j)
            assert labels(a, b) == labels(i, j)
            assert len(a) == size - len(set(labels(i, j)))
            assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
