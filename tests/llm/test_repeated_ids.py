"""Rows that repeat a doc_id with other texts are documents of their own."""

import hashlib
import random

from gridmeter.llm import line_dedup, stable_projection, substring_dedup
from gridmeter.llm.storage import with_keys


def digest(text):
    return hashlib.sha256((text or "").encode()).digest()


def test_keys(make_docs):
    docs = make_docs([(3, "b", "en", "s"), (1, "x", "en", "s"), (3, "a", "en", "s"), (3, "b", "de", "s"), (None, "b", "en", "s"), (2, None, "en", "s"), (2, "", "en", "s")])
    got = {(r.doc_id, r.text, r.lang): r.key for r in with_keys(docs).collect()}
    order = sorted({(i, digest(t)) for i, t, _ in got if i is not None})
    assert got == {(i, t, lang): None if i is None else order.index((i, digest(t))) for i, t, lang in got}
    assert {r.doc_id: r.key for r in with_keys(docs.filter("doc_id = 1 OR doc_id IS NULL")).collect()} == {1: 1, None: None}


def test_windows(make_docs):
    rng = random.Random(9)
    a, b = (" ".join(f"{c}{i}" for i in range(25)) for c in "ab")
    docs = [(1, a), (5, a), (5, b), (7, b + " x"), (5, a)] + [(rng.randrange(20, 30), " ".join(rng.choices("pqr", k=rng.randint(10, 90)))) for _ in range(25)]
    order = sorted({(i, digest(t)) for i, t in docs})
    first, of = {}, {}
    for i, t in docs:
        w, place = t.split(), order.index((i, digest(t)))
        of[place] = [tuple(w[s : s + 20]) for s in range(len(w) - 19)]
        for s, k in enumerate(of[place]):
            first[k] = min(first.get(k, (place, s)), (place, s))
    want = []
    for i, t in docs:
        place = order.index((i, digest(t)))
        gone = {p for s, k in enumerate(of[place]) if first[k] != (place, s) for p in range(s, s + 20)}
        want.append((i, len(t.split()), " ".join(w for p, w in enumerate(t.split()) if p not in gone)))
    got = substring_dedup.remove_repeated(make_docs([(i, t, "en", "s") for i, t in docs]), 20).collect()
    assert sorted((r.doc_id, r.n_words, r.kept_text) for r in got) == sorted(want)
    assert sorted(r.n_removed for r in got if r.doc_id == 5) == [0, 25, 25]


def test_lines(make_docs):
    a, b, c = "a line that several documents have", "another line, which one document has", "and a third one of some length, too"
    docs = make_docs([(1, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (6, f"{b}\n{c}", "en", "s"), (None, a, "en", "s")])
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.without_duplicates(docs).collect()) == [(0, a), (1, a), (5, ""), (5, b), (6, c)]
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in line_dedup.report(docs).collect()) == [(0, 1, 0), (1, 1, 0), (5, 1, 0), (5, 1, 1), (6, 2, 1)]
    assert line_dedup.without_duplicates(docs).columns == docs.columns


def test_vectors_of_the_smallest_numbers(spark):
    rows = [(0, [1.0, 0.5]), (1, [5e-324, 0.0]), (2, [0.0, -5e-324]), (3, [2.0, 0.0]), (4, [1e-310, 5e-311]), (5, [1e308, 1e308])]
    got = {r.vec_id: r.score for r in stable_projection.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=5).collect()}
    assert [round(got[i], 9) for i in (1, 2, 3, 4, 5)] == [0.894427191, -0.447213595, 0.894427191, 1.0, 0.948683298]
