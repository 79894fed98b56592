"""Substring removal, n-gram join and line removal against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import EDGES
from gridmeter.llm import kernels, line_dedup, linking, ngram_join, ranges, storage, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(vocabulary, n=120, seed=1):
    """Texts, exact copies, near copies with edits, and passages that several share."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(vocabulary, k=55))
    texts = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and texts:
            texts.append(rng.choice(texts))
        elif kind < 0.5 and texts:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = rng.choices(vocabulary, k=rng.randint(1, 160))
            texts.append(" ".join(w) + ("\n" + passage if kind > 0.9 else ""))
    return texts


def brute_removed(docs, width=20):
    first, spans = {}, []
    for i, t in docs:
        w = words(t)
        for s in range(len(w) - width + 1):
            spans.append((i, s, tuple(w[s : s + width])))
    for i, s, k in spans:
        first[k] = min(first.get(k, (i, s)), (i, s))
    out = {i: set() for i, _ in docs}
    for i, s, k in spans:
        if (i, s) != first[k]:
            out[i] |= set(range(s, s + width))
    return out


def test_substrings_match_brute_force(make_docs, vocabulary):
    docs = list(enumerate(corpus(vocabulary)))
    got = {r.doc_id: r for r in substring_dedup.remove_repeated(make_docs([(i, t, "en", "s") for i, t in docs]), 20, digest=True).collect()}
    for (i, t), gone in zip(docs, brute_removed(docs).values(), strict=True):
        w = words(t)
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_on_edges(make_docs):
    rows = substring_dedup.remove_repeated(make_docs(EDGES), 20).collect()
    assert len(rows) == len(EDGES)
    long = next(r for r in rows if r.doc_id == 7)
    assert long.n_words == 60_001 and long.kept_text == "w end"
    assert all(r.n_removed == 0 for r in rows if r.doc_id != 7)
    assert not substring_dedup.remove_repeated(make_docs(EDGES).limit(0)).collect()


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(fold(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_ngram_join_matches_brute_force(make_docs, vocabulary, k, percent, seed):
    docs = list(enumerate(corpus(vocabulary, 200, seed)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(make_docs([(i, t, "en", "s") for i, t in docs]), k, percent).collect()}
    assert got == brute_components(docs, k, percent)


def test_ngram_join_of_a_large_near_copy_group(make_docs, vocabulary):
    """Frequent tokens in long and short sets: pairs of tokens, and single ones."""
    rng = random.Random(3)
    docs = []
    for size in (60, 400):
        base = rng.choices(vocabulary, k=size)
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randint(0, size // 40)):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(make_docs([(i, t, "en", "s") for i, t in docs]), 3, 90).collect()}
    assert got == brute_components(docs, 3, 90)


@pytest.mark.parametrize("percent", [90, 80])
def test_ngram_join_links_all_small_sizes_at_the_threshold(make_docs, percent):
    """Pairs that share no word with any other document, with as few words in common as may link."""
    docs = []
    for a in range(1, 41):
        for b in range(-(-a * percent // 100), a + 1):
            common = -(-percent * (a + b) // (100 + percent))
            name = lambda kind, n: [f"{kind}{a}x{b}x{i}" for i in range(n)]  # noqa: B023, E731
            docs += [(len(docs), " ".join(name("c", common) + name("a", a - common))), (len(docs) + 1, " ".join(name("c", common) + name("b", b - common)))]
    got = {r.doc_id: r.component_id for r in ngram_join.linked(make_docs([(i, t, "en", "s") for i, t in docs]), 1, percent).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_ngram_join_links_a_document_and_one_shorter_by_a_word(make_docs):
    text = "a b c d e f g h i j k l"
    got = {r.doc_id: r.component_id for r in ngram_join.linked(make_docs([text, text[:-2]]), 3, 90).collect()}
    assert got == {0: 0, 1: 0}


def test_ngram_join_on_edges(make_docs):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(make_docs(EDGES)).collect()]
    assert len(rows) == len(EDGES)
    by = {r[0]: r for r in rows}
    assert by[0][1:] == (0, 0) and by[1][1:] == (0, 1) and by[2][1:] == (0, 2)
    assert by[4][1:] == (1, 4) and by[5][1:] == (1, 4) and by[3][1:] == (1, 3)
    assert by[None][2] is None and by[8][2] == 8
    assert not ngram_join.linked(make_docs(EDGES).limit(0)).collect()


def test_lines_match_brute_force(make_docs, vocabulary):
    rng = random.Random(4)
    pool, texts = [], []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            if pool and rng.random() < 0.4:
                w = rng.choice(pool).split(" ")
                if rng.random() < 0.6:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
                lines.append(" ".join(w))
            else:
                lines.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))))
            pool.append(lines[-1])
            if rng.random() < 0.2:
                lines.append("  ")
        texts.append("\n".join(lines))
    first, sets, occurrences = {}, {}, []
    for i, t in enumerate(texts):
        for j, line in enumerate(t.split("\n")):
            b = line.lower().encode().strip()
            if b:
                occurrences.append((i, j, b))
                sets[b] = {b[x : x + 8] for x in range(max(1, len(b) - 7))}
    names = list(sets)
    parent = {b: b for b in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(names):
        for b in names[:x]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    for i, j, b in occurrences:
        first.setdefault(find(b), (i, j))
    want = {i: [] for i in range(len(texts))}
    for i, j, b in occurrences:
        if first[find(b)] != (i, j):
            want[i].append(j)
    docs = make_docs(texts)
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    assert {i: r.removed_lines for i, r in got.items()} == want
    kept = {r.doc_id: r.text for r in line_dedup.without_duplicates(docs).collect()}
    for i, t in enumerate(texts):
        assert kept[i] == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in want[i])


def test_lines_on_edges(make_docs):
    rows = line_dedup.report(make_docs(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.doc_id: r.n_removed for r in rows}[5] == 1  # equal to document 4 but for capitals
    assert not line_dedup.report(make_docs(EDGES).limit(0)).collect()


def test_keys_deal_evenly(spark):
    keys = kernels.even_keys(13, 3)
    df = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(13, "k")
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert counts == [3] * 13


def test_long_spans_with_equal_polynomials_differ():
    """Two Thue-Morse strings, which collide in every polynomial hash modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate({97: 98, 98: 97})
    data = np.frombuffer((one + two).encode(), np.uint8)
    a, b = kernels.span_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b
    low = np.frombuffer((one + one.upper()).encode(), np.uint8)
    a, b = kernels.span_hashes(low, np.array([0, 2048]), np.array([2048, 4096]), kernels.FOLDED)
    assert a == b


@pytest.mark.parametrize("shape", ["path", "star", "cliques"])
def test_components_against_a_plain_union_find(spark, shape):
    rng = random.Random(shape)
    edges = {"path": [(i, i + 1) for i in range(300)], "star": [(7, i) for i in range(300)], "cliques": [(10 * rng.randrange(40) + rng.randrange(10), 10 * rng.randrange(4) + rng.randrange(10)) for _ in range(150)]}[shape]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in linking.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_one_line_in_most_rows_costs_a_row_for_each_block(make_docs, vocabulary):
    """What any home gets of a line that every document has: a place for each block of texts, not for each document."""
    docs = make_docs(["the same line in all documents\n" + f"{w} stands alone in here" for w in vocabulary[:400]])
    rows = line_dedup.report(docs).collect()
    assert sum(0 in r.removed_lines for r in rows) == 399
    blocks = docs.select("doc_id", "text").coalesce(1).mapInArrow(line_dedup._read_lines(kernels.even_keys(4, 1)), "part int, kind int, payload binary").filter(f"kind = {line_dedup.FIRSTS}").collect()
    first = np.concatenate([kernels.unpack(bytes(r.payload), np.uint64, np.int64, np.int32, np.int32)[0] for r in blocks])
    assert len(first) == len(np.unique(first))


def test_one_shingle_in_most_documents_costs_few_rows(vocabulary):
    """Of a hot token only the ends of each size leave a block."""
    nodes = np.arange(5000, dtype=np.uint64)
    rows = ngram_join._prefix_rows(np.full(5000, 9, np.uint64), nodes, (nodes % 3 + 10).astype(np.uint32), kernels.even_keys(4, 1))
    tokens = [kernels.unpack(p, np.uint64, np.uint64, np.uint32) for _, kind, p in rows if kind == ngram_join.TOKENS]
    assert sum(len(t[0]) for t in tokens) == 6
    assert sum(len(kernels.unpack(p, np.uint64, np.uint32, np.uint32)[0]) for _, kind, p in rows if kind == ngram_join.COUNTS) == 5000


def test_blocks_never_share_a_number():
    numbers = [ranges.block_number(t, n) for t in (0, 1, 4095, (1 << 19) - 1) for n in (0, 1, 4095)]
    assert len(set(numbers)) == 12 and ranges.batch([(n, ranges.asker(n), b"") for n in numbers])["part"].to_pylist() == numbers
    for task, number in ((0, 4096), (1 << 19, 0)):
        with pytest.raises(OverflowError):
            ranges.block_number(task, number)


def linked_at_homes(sets, keys, percent):
    """One round of linking.connect over a single bucket of sets by node, step by step: wanted (node, home), edges, and nodes that stay in the bucket."""
    nodes = np.array(sorted(sets), np.uint64)
    home = {int(n): int(keys[(int(n) >> 32) * len(keys) >> 32]) for n in nodes}
    held = {}
    for part in set(home.values()):
        its = np.array([n for n in nodes if home[int(n)] == part], np.uint64)
        n = np.array([len(sets[int(x)]) for x in its], np.uint32)
        none = np.zeros(len(its), np.uint32)
        raw = [np.array(sorted(sets[int(x)]), np.uint64).tobytes() for x in its]
        held[part] = {
            linking.SETS: [linking.packed_sets(its, n, none, np.array([len(x) for x in raw]), b"".join(raw))],
            linking.POSTINGS: [kernels.pack(np.full(len(its), 5, np.uint64), its, n, none, its)],
        }
    asked = {}
    for part, blocks in held.items():
        for _, kind, payload in linking._propose(linking.FIRST, keys)(part, linking.POSTINGS, blocks[linking.POSTINGS][0]):
            asked.setdefault(kind, []).append(payload)
    wanted = []
    for part, kind, payload in linking._choose(linking.FIRST, keys)(0, asked):
        held[part].setdefault(kind, []).append(payload)
        if kind == linking.WANTED:
            wanted += list(zip(*(x.tolist() for x in kernels.unpack(payload, np.uint64, np.int32)), strict=True))
    for part in list(held):
        for to, kind, payload in linking._lend(part, held[part]):
            held[to].setdefault(kind, []).append(payload)
    edges, stay = [], []
    for part, blocks in held.items():
        for _, kind, payload in linking._compare(percent, linking.packed_tokens)(part, blocks):
            if kind == linking.EDGES:
                edges += list(zip(*(x.tolist() for x in kernels.unpack(payload, np.uint64, np.uint64)), strict=True))
            if kind == linking.POSTINGS:
                stay += kernels.unpack(payload, *linking._POSTING)[1].tolist()
    return wanted, edges, stay


def test_a_bucket_of_two_lends_one_set():
    keys = kernels.even_keys(4, 1)
    low, high = 7 << 40, 3 << 62
    wanted, edges, stay = linked_at_homes({low: set(range(50)), high: set(range(49))}, keys, 80)
    assert wanted == [(low, int(keys[3]))] and edges == [(high, low)] and not stay


def test_small_buckets_end_in_one_round_with_all_their_links():
    rng = random.Random(5)
    for seed in range(20):
        rng.seed(seed)
        sets = {}
        for _ in range(rng.randint(2, linking.SMALL)):
            base = set(range(40)) if rng.random() < 0.4 else set(rng.sample(range(1000), 40))
            sets[rng.getrandbits(64)] = base - set(rng.sample(sorted(base), rng.randint(0, 5)))
        _, edges, stay = linked_at_homes(sets, kernels.even_keys(rng.randint(1, 5), 1), 80)

        def parts(pairs, names):
            parent = {x: x for x in names}

            def find(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for a, b in pairs:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
            return {x: find(x) for x in names}

        alike = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        assert parts(edges, sets) == parts(alike, sets) and not stay


def test_near_copies_of_one_home_are_tied_by_a_tree():
    sets = {(i + 1) << 20: set(range(100)) - {i % 100} for i in range(300)}
    _, edges, stay = linked_at_homes(sets, kernels.even_keys(1, 1), 80)
    assert len(edges) == 299 and len(stay) == 296


def test_bands_go_with_the_texts_of_a_block(make_docs, vocabulary):
    """Homes need not read all texts for the bands; what they get of a band are its upper bits."""
    texts = ["\n".join(" ".join(vocabulary[i + j : i + j + 9]) for j in range(3)) for i in range(0, 60, 2)]
    keys = kernels.even_keys(3, 1)
    blocks = make_docs(texts).select("doc_id", "text").coalesce(1).mapInArrow(line_dedup._read_lines(keys), ranges.BLOCKS).collect()
    for part in {r.part for r in blocks if r.kind == line_dedup.TEXTS}:
        payloads = lambda kind: [bytes(r.payload) for r in blocks if r.part == part and r.kind == kind]  # noqa: B023, E731
        node, starts, ends, data = line_dedup._texts(payloads(line_dedup.TEXTS))
        its, bands = line_dedup._banded(payloads(line_dedup.BANDED))
        assert its.tolist() == sorted(node.tolist())
        want = {int(n): line_dedup._bands(*line_dedup._grams(data[a:b], np.array([0]), np.array([b - a])))[0].tolist() for n, a, b in zip(node, starts, ends, strict=True)}
        assert {int(n): b.tolist() for n, b in zip(its, bands, strict=True)} == want
        assert all(b % (1 << 24) == 0 for bs in want.values() for b in bs)


def sets_in_blocks(sets, keys, key):
    """Rows of a state for linking.connect: all nodes in one bucket, in a block for each node."""
    rows = []
    for node, its in sets.items():
        one, n, none = np.array([node], np.uint64), np.array([len(its)], np.uint32), np.zeros(1, np.uint32)
        part, raw = int(keys[(node >> 32) * len(keys) >> 32]), np.array(sorted(its), np.uint64).tobytes()
        rows.append((part, linking.SETS, linking.packed_sets(one, n, none, np.array([len(raw)]), raw)))
        rows.append((part, linking.POSTINGS, kernels.pack(np.array([key], np.uint64), one, n, none, one)))
        rows.append((part, linking.LABELS, kernels.pack(one, one)))
    return rows


def test_what_a_step_gives_leaves_in_small_batches():
    out = list(ranges.each_part(lambda part, blocks: [(part, 1, bytes(1 << 19)) for _ in range(16)])(iter([ranges.batch([(7, 0, b"x")])])))
    assert sum(b.num_rows for b in out) == 16 and max(b.nbytes for b in out) < 3 << 19


def test_lent_sets_are_compared_as_they_are_read():
    """A home holds its own sets, not all that it is lent."""
    read, seen = [], []

    def rows():
        for i, kind in enumerate([linking.LABELS, linking.SETS, *[linking.LENT] * 9]):
            read.append(i)
            yield ranges.batch([(3, kind, bytes([i]))])
        yield ranges.batch([(4, linking.LABELS, b"y")])

    def step(part, blocks):
        for payload in blocks.get(linking.LENT, []):
            seen.append((payload[0], len(read)))
        yield part, 0, b"".join(blocks[linking.LABELS])

    out = [r for b in ranges.each_part(step, last=linking.LENT)(rows()) for r in b.to_pylist()]
    assert [r["part"] for r in out] == [3, 4] and seen == [(i, i + 1) for i in range(2, 11)]


def test_blocks_of_a_home_give_one_proposal_for_a_key():
    """However many blocks a home's postings stand in, one row for each range of keys tells of them."""
    keys = kernels.even_keys(4, 1)
    rng = np.random.default_rng(2)
    blocks = []
    for _ in range(50):
        key = np.sort(rng.integers(0, 1 << 64, 20, dtype=np.uint64))
        node = np.repeat(rng.integers(0, 1 << 64, 1, dtype=np.uint64), 20)
        blocks.append(kernels.pack(key, node, np.full(20, 9, np.uint32), np.zeros(20, np.uint32), node))
    rows = list(linking._propose(linking.FIRST, keys)(5, linking.POSTINGS, *blocks))
    assert len(rows) == 2 * len(keys)
    assert sum(len(kernels.unpack(p, np.uint64)[0]) for _, kind, p in rows if kind == 10) == 1000


def test_sets_that_are_left_have_as_few_homes_as_they_fill(spark, monkeypatch):
    """A bucket of many unlike sets among 16 homes: later rounds have one home, which is lent each set at most once; links are those of all pairs."""
    rng = random.Random(3)
    sets, keys = {}, kernels.even_keys(16, 1)
    for _ in range(120):
        base = set(rng.sample(range(1, 100_000), 40))
        for _ in range(rng.choice((1, 1, 2))):
            sets[rng.getrandbits(64)] = base - set(rng.sample(sorted(base), rng.randint(0, 2)))
    homes, choose = [], linking._choose
    monkeypatch.setattr(linking, "_choose", lambda pivots, keys: homes.append(len(keys)) or choose(pivots, keys))
    storage.small_batches(spark)
    state = storage.materialize(spark.createDataFrame(sets_in_blocks(sets, keys, 77), ranges.BLOCKS), "kind")
    got = {r.node & (1 << 64) - 1: r.component & (1 << 64) - 1 for r in linking.label_rows(linking.connect(state, 80, keys, scattered=True)).collect()}
    alike = {a: min(b for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
    assert got == alike and homes[0] == 16 and len(homes) > 2 and set(homes[1:]) == {1}
