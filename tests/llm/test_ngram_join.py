"""The n-gram join with other shingles and thresholds, shared ids, and groups that are dealt out."""

import itertools
import random

import pytest
from test_corpus_operators import family

from fathomline.llm import ngram_join


def classes_of(rows, shingle, percent):
    """(doc_id, text) -> the smallest doc_id that links reach, over all pairs of rows."""
    sets = []
    for _, x in rows:
        ws = (x or "").lower().split()
        sets.append({tuple(ws[i : i + shingle]) for i in range(max(len(ws) - shingle + 1, 1))} if ws else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            up[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def found(spark, rows, **options):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_components(d, **options).collect())


@pytest.mark.parametrize(("shingle", "percent"), [(5, 80), (1, 70), (2, 95)])
def test_other_shingles_and_thresholds(spark, shingle, percent):
    texts = [*family(1, 20), *family(2, 10, 40), "", "one", "one two", "One Two", "a b c d", "a b c d e"]
    rows = [*enumerate(texts)]
    assert found(spark, rows, shingle=shingle, percent=percent) == classes_of(rows, shingle, percent)


@pytest.mark.parametrize("options", [{}, {"block": 3}, {"block_keys": 100}, {"block": 5, "block_keys": 200, "salts": 2}])
def test_groups_that_are_dealt_out_lose_no_link(spark, options):
    rng = random.Random(3)
    shared = [f"z{i}" for i in range(6)]  # rare words in all of them, so that unlike documents meet in one group
    texts = [" ".join([*shared, *x.split()]) for x in [*family(5, 30, 60), *family(6, 12, 60), *(" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12))]]
    rows = [*enumerate(texts)]
    assert found(spark, rows, **options) == classes_of(rows, 3, 90)


def test_rows_that_share_an_id_but_not_their_text(spark):
    a, b = family(8, 2, 200)
    c, d = family(9, 2, 200)
    rows = [(7, a), (3, a), (7, c), (9, d), (7, "x y z w"), (5, b), (7, "x y z w")]
    assert found(spark, rows) == classes_of(rows, 3, 90)
    table = spark.createDataFrame([(i, x, k) for k, (i, x) in enumerate(rows)], "doc_id long, text string, _place int")
    kept = ngram_join.one_of_each(table)
    assert kept.columns == table.columns
    ids = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(7, c), (7, "x y z w")} <= ids and kept.filter("text = 'x y z w'").collect()[0]["_place"] == 4 and kept.count() == len(ids)
