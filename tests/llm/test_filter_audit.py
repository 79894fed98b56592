import random
import re
from itertools import permutations

import pytest

from cases import EDGES
from gridmeter.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int"


def brute_force(docs, labels):
    """(part, order, step) -> the seven counts, filter by filter and document by document."""
    fails = []
    for doc_id, text, lang, *_ in docs:
        words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text or "")) > 3 * len(text or ""), "D": bool(re.search("[#$%&*|]", text or ""))}
        own["E"] = doc_id is not None and any(d[0] is not None and d[0] < doc_id and (d[1] or "") == (text or "") for d in docs)
        has = lambda i: any(x[0] == doc_id and x[i] == 1 for x in labels if x[0] is not None)  # noqa: E731, B023
        fails.append((lang or "", {f for f, v in own.items() if v}, has(1), has(2)))
    out = {}
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [x for x in mine if f in x[1] and not x[1] & set(order[:k])]
                out[part, "".join(order), k + 1] = [sum(not x[1] & set(order[: k + 1]) for x in mine), len(here), sum(f in x[1] for x in mine) - len(here), sum(x[1] == {f} for x in mine), sum(x[2] for x in here), sum(x[3] for x in here), f]
    for (part, _, _), row in out.items():
        row[-1] = shapley_of(fails, part, row[-1])
    return {k: tuple(v) for k, v in out.items()}


def shapley_of(fails, part, f):
    return sum(f in x[1] and not x[1] & set(order[: order.index(f)]) for order in permutations("ABCDE") for x in fails if x[0] == part)


def found(df):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, make_docs, seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(["some", "words", "HERE", "a|b", "c", "d", "e", "100%"], k=n)) for n in (0, 1, 5, 199, 200, 201, 300)] + [" ".join(f"w{i}" for i in range(250)), "É" * 400, None]
    docs = [(rng.choice([*range(30), None]), rng.choice(texts), rng.choice(["en", "de", None, ""]), "s") for _ in range(120)]
    docs += EDGES
    labels = [(rng.choice([*range(30), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    got = filter_audit.interactions(make_docs(docs), spark.createDataFrame(labels, LABELS))
    assert found(got) == brute_force(docs, labels)


def test_a_text_that_most_rows_have(spark, make_docs):
    docs = [(i, "the same Text" if i % 3 else f"text {i}", "en", "s") for i in range(600)]
    got = found(filter_audit.interactions(make_docs(docs), spark.createDataFrame([], LABELS)))
    assert got["en", "EABCD", 1][:2] == (201, 399)
    assert got["en", "EABCD", 2][:3] == (0, 201, 399)
    for order in ("ABCDE", "EDCBA"):
        assert sum(got["en", order, k][1] for k in range(1, 6)) + got["en", order, 5][0] == 600


def test_no_documents(spark, make_docs):
    docs = make_docs([(1, "x", "en", "s")]).filter("doc_id > 1")
    assert filter_audit.interactions(docs, spark.createDataFrame([], LABELS)).count() == 0
    assert len(filter_audit.ORDERS) == 120
