"""Extraction, sharding, neighbours, mixing, decontamination, toxicity and token files."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cases import EDGES
from gridmeter.llm import decontamination, mixing, sharding, site_style, stable_projection, token_files, toxicity
from gridmeter.llm.storage import shared_folder

PAGES = "page_id long, url string, html string"


# --- extraction
def test_landmarks_and_names_are_left_out():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site <a href=/>name</a></header>
    <nav><ul><li>Menu<li>More</ul></nav><div class="cookie-banner">We use cookies</div><aside>Aside</aside><main><article><header><h1>Title &amp; more</h1></header>
    <p>First <b>bold</b>text<p>Second&nbsp;one<br>line</p><div class="share-buttons">Share</div><form><input>Mail me</form><section id="comments"><p>I disagree</section></article></main>
    <div>Related things</div><footer>&copy; us</footer></body></html>"""
    assert site_style.main_text(page) == "Title & more First boldtext Second one line"


@pytest.mark.parametrize("page", ["", "plain", "<p>a<p>b", "<div><p>a</div>b", "<b>a<", "a &am", "<!-- x", "<script>never closed", "<p class='x>y", "</p></p>a"])
def test_broken_markup_does_not_crash(page):
    assert isinstance(site_style.main_text(page), str)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<p title="some hidden gem">Article sentence.</p>', "Article sentence."),
        ('<p>See <a title="the hidden history">the book</a> now</p>', "See the book now"),
        ('<p data-id="ad">Kept</p><p data-hidden=1>too</p>', "Kept too"),
        ("<article><p data-x=it's>One</p><p>Two</p></article>", "One Two"),
        ('<p>One</p><p class="x>Two</p>', "One Two"),
        ("<article class=teaser><p>Read on</p></article><div><p>The story itself.</p></div>", "Read on The story itself."),
        ('<div class="share-price"><p>12 euros</p></div><p class=search-term>word</p><div class="form-group">x</div>', "12 euros word x"),
        ('<p>Keep</p><div class="share-buttons">a</div><div class="search-form">b</div><div id=site-footer>c</div><div class="cookie-banner">d</div><p hidden>e</p>', "Keep"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold</p></article>", "Let x=1 hold"),
        ('<a href="?a=1&b>2">go</a> on <b class=\'q"q\'>x</b>', "go on x"),
    ],
)
def test_attributes_are_read_as_attributes(page, text):
    assert site_style.main_text(page) == text


STORY = "<p>" + "A sentence of the story itself. " * 9 + "</p>"
TOLD = " ".join(["A sentence of the story itself."] * 9)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p class="ad-hoc">One</p></article>', "One"),
        ('<article><section id="history-of-the-banner"><p>One</p></section></article>', "One"),
        ('<div id="menu-of-the-day"><p>Soup</p></div>', "Soup"),
        ('<article><div class="cookie-recipe"><p>Flour</p></div></article>', "Flour"),
        ('<article><p class="dialog">Said she.</p></article>', "Said she."),
        ('<article><h2 id="comments-on-the-budget">Budget</h2><p>Text</p></article>', "Budget Text"),
        ('<article><p class="newsletter-history">Text</p></article>', "Text"),
        (f"<form id=aspnetForm><input><label>Search</label><article><h1>T</h1>{STORY}</article><select><option>x</select></form>", f"T {TOLD}"),
        (f"<form id=aspnetForm><input><h1>T</h1>{STORY}<div><button>Go</button></div></form>", f"T {TOLD}"),
        (f"<article>{STORY}</article><form><p>Your name</p><input></form>", TOLD),
        (f"<div>{STORY}</div><form><p>Your name</p><input></form>", TOLD),
        (f"<article><h1>T</h1>{STORY}</article><article><h3><a href=/x>Other headline</a></h3></article>", f"T {TOLD}"),
        (f"<main><h1>T</h1><article>{STORY}</article></main>", f"T {TOLD}"),
        (f"<article><h1>T</h1><section><article>{STORY}</article></section></article>", f"T {TOLD}"),
        (f"<article><h3>Other</h3><p>Read on</p></article><div class=story>{STORY}</div>", TOLD),
        (f"<article>{STORY}</article><div><p>Short note</p></div>", TOLD),
        (f'{STORY}<p style="Visibility: hidden">x</p><p aria-hidden="TRUE">y</p><div class="ad-slot-3">z</div><div class="entry-footer">by</div>', TOLD),
    ],
)
def test_names_forms_and_teasers_do_not_cost_the_article(page, text):
    assert site_style.main_text(page) == text


def test_boilerplate_goes_from_short_stories_too(spark):
    rng = random.Random(5)
    boxes = "".join(f"<div class=b{c}><p>{' '.join(c * 4 for _ in range(18))}</p></div>" for c in "uvwxyz")
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    pages = [(i, "http://a.example/", f"<html><body>{boxes}<div class=story><p>{' '.join(rng.choices(words, k=6))}</p></div></body></html>") for i in range(8)]
    rows = site_style.extract(spark.createDataFrame(pages, PAGES)).collect()
    assert all(r.text == re.search("story><p>(.*?)</p>", pages[r.page_id][2])[1] for r in rows)


def test_copies_that_differ_in_their_headings_keep_their_text(spark):
    pages = [(i, "http://a.example/", f"<article><h1>Day {chr(97 + i)}</h1>{STORY}</article>") for i in range(9)]
    rows = site_style.extract(spark.createDataFrame(pages, PAGES)).collect()
    assert all(r.text == f"Day {chr(97 + r.page_id)} {TOLD}" for r in rows)


def test_importance_against_a_plain_version(spark):
    """Entropies of a small host, counted page by page."""
    rng = random.Random(8)
    pages = []
    for i in range(12):
        tag = rng.choice(["p", "p", "pre"])
        body = "".join(f"<{tag}>{rng.choice('abc')} {rng.choice('defghi')}</{tag}>" for _ in range(rng.randint(1, 3)))
        pages.append(f"<html><body><div class=s>{body}</div><div class=menu-card><p>{rng.choice(['same', 'same', 'same', 'other'])}</p></div><div class=z>always</div></body></html>")
    pages = sorted(set(pages))
    shown, styles, times = defaultdict(set), defaultdict(Counter), Counter()
    for k, page in enumerate(pages):
        blocks, seqs = site_style._kept(page)
        paths = {"/".join(b.node.path.split("/")[:n]) for b in blocks for n in range(2, len(b.node.path.split("/")) + 1)}
        for path in paths:
            styles[path]["|".join(seqs[path])] += 1
        for b in blocks:
            shown[b.node.path, b.text()].add(k)
            times[b.node.path, b.text()] += 1
    want = set()
    for leaf in {path for path, _ in times}:
        m, total = sum(styles[leaf].values()), sum(n for (p, _), n in times.items() if p == leaf)
        if m < site_style.MIN_PAGES:
            continue
        content = 1 - sum(n * math.log(len(shown[leaf, t]), m) for (p, t), n in times.items() if p == leaf) / total
        parts, value = leaf.split("/"), 0.0
        for far in range(len(parts) - 1):
            up = styles["/".join(parts[: len(parts) - far])]
            n = sum(up.values())
            value += 0.1 * 0.9**far * -sum(c / n * math.log(c / n, n) for c in up.values())
        value += 0.9 ** (len(parts) - 1) * content
        if value < (0.4 if "menu-card" in leaf else 0.2):
            want.add(leaf)
    low = site_style.low_paths(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()
    assert want and {p for r in low for p in r.low} == want and len(want) < len({p for p, _ in times})


def test_long_broken_markup_takes_linear_time():
    assert site_style.main_text("<p a=" * 20_000 + "'" * 20_000 + "<b \"" * 20_000) is not None


def test_site_statistics_find_unmarked_boilerplate(spark):
    rng = random.Random(1)
    names = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    pages = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(rng.choices(names, k=30))}</p>" for _ in range(rng.randint(2, 6)))
        pages.append((i, f"http://a.example/{i}", f"<html><body><div class=top><ul><li><a href=/x>Home page</a><li><a href=/y>About us</a></ul></div><div id=c><h2>{names[i]}</h2>{body}</div><div class=b>Call us any time</div></body></html>"))
    pages += [(100 + i, "http://b.example/", pages[0][2]) for i in range(20)]  # copies count once and keep their text
    rows = {r.page_id: r for r in site_style.extract(spark.createDataFrame(pages, PAGES).withColumn("host", F.lit("clash"))).collect()}
    assert len(rows) == 60
    for i in range(40):
        assert "Call us" not in rows[i].text and "Home" not in rows[i].text and rows[i].text.startswith(names[i]) and rows[i].n_chars == len(rows[i].text)
    assert "Call us" in rows[105].text


def test_pages_on_edges(spark):
    rows = site_style.extract(spark.createDataFrame([(1, None, None), (1, None, ""), (None, "x", "a &lt; b"), (2, "http://h", "<p>" + "long " * 100_000)], PAGES)).collect()
    assert sorted((r.n_chars, r.text[:5]) for r in rows) == [(0, ""), (0, ""), (5, "a < b"), (499_999, "long ")]
    assert not site_style.extract(spark.createDataFrame([], PAGES)).collect()


# --- sharding
def test_shards_hold_all_rows_through_versions(spark, make_docs):
    docs = make_docs(EDGES)
    store = sharding.ShardStore(spark, shared_folder(spark), docs.schema, target_bytes=1 << 20, fan_in=4)
    assert store.version() == 0 and not store.read().collect()
    for i in range(6):
        assert store.append(docs.repartition(2)) == i + 1
    small = store.manifest()
    assert {t for _, t, _ in small} == {0} and len(small) >= 6
    version = store.settle()
    assert version > 6 and len(store.manifest()) < len(small) and max(t for _, t, _ in store.manifest()) >= 1
    want = docs
    for _ in range(5):
        want = want.unionAll(docs)
    assert store.read().exceptAll(want).count() == 0 and store.read().count() == 6 * len(EDGES)
    assert store.read(6).count() == 6 * len(EDGES)  # an old version still reads
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(), version - 1)
    assert sharding.placed(store).filter("shard IS NULL OR tier IS NULL").count() == 0


def test_the_second_of_two_committers_starts_over(spark, make_docs, monkeypatch):
    """The second has looked for the version before the first commits, and publishes after it."""
    docs = make_docs(["one", "two"])
    path = shared_folder(spark)
    first, second = (sharding.ShardStore(spark, path, docs.schema, 1 << 20) for _ in range(2))
    publish, meanwhile = second._publish, []

    def late(file, target):
        if not meanwhile:
            meanwhile.append(first.append(docs.filter("doc_id = 0")))
        return publish(file, target)

    monkeypatch.setattr(second, "_publish", late)
    with pytest.raises(sharding.Conflict):
        second.commit([], second.version())
    meanwhile.clear()
    assert second.append(docs.filter("doc_id = 1")) == 3 and meanwhile == [2]
    assert sorted(r.doc_id for r in first.read().collect()) == [0, 0, 1]


def test_runs_are_of_similar_sizes(spark, make_docs):
    store = sharding.ShardStore(spark, shared_folder(spark), make_docs(["x"]).schema, 128 << 20, 4)
    size = lambda b: ("f", store.tier(b), b)
    assert [store.tier(b) for b in (1 << 10, 2 << 20, 8 << 20, 32 << 20, 64 << 20, 1 << 30)] == [0, 1, 2, 3, 4, 4]
    assert not store.runs([size(1 << 10)] * 3 + [size(60 << 20)] * 3 + [size(70 << 20)] * 9)
    assert set(store.runs([size(1 << 10)] * 4 + [size(60 << 20)] * 3)) == {0}


def test_tiny_appends_end_in_shards_that_may_still_merge(spark, make_docs):
    docs = make_docs(["one row"]).coalesce(1)
    store = sharding.ShardStore(spark, shared_folder(spark), docs.schema, fan_in=4)
    names = store._write(docs.withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(255)))).repartition(256, "doc_id").select(*docs.columns))
    assert len(names) > 100  # files of a row or a few
    store.commit(names, store.version())
    store.settle()
    left = store.manifest()
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(256))
    assert len(left) < 4 * 4 and {t for _, t, _ in left} == {0} and all(t == store.tier(b) for _, t, b in left)
    for i in range(4):
        store.append(docs.withColumn("doc_id", F.lit(1000 + i).cast("long")))
    store.settle()
    assert len(store.manifest()) < len(left) + 4 and store.read().count() == 260


def test_unlike_sizes_do_not_merge(spark, make_docs):
    store = sharding.ShardStore(spark, shared_folder(spark), make_docs(["x"]).schema, 128 << 20, 4)
    size = lambda b: (f"f{b}", store.tier(b), b)
    assert not store.runs([size(300)] * 3 + [size(5_000)] * 3 + [size(70_000)] * 3)
    run = store.runs([size(300)] * 4 + [size(5_000)] * 5 + [size(70_000)] * 3 + [size(2 << 20)] * 4)
    assert {t: {b for _, _, b in r} for t, r in run.items()} == {0: {5_000}, 1: {2 << 20}}


def test_empty_table_has_a_version(spark, make_docs):
    store = sharding.shard(make_docs(EDGES).limit(0), shared_folder(spark))
    assert store.version() >= 1 and store.read().count() == 0


# --- neighbours
def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    v = (centres[rng.integers(0, 12, 900)] + 0.6 * rng.normal(size=(900, 24))).astype(np.float32)
    v[100:400] = v[100]  # a third is one vector
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(2000, None, 1), (2050, [0.0] * 24, 1), (2100, [float("nan")] + [1.0] * 23, 1), (2101, [None] + [1.0] * 23, 1), (2102, [1.0], 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in stable_projection.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 50))
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    hits = 0
    for q, found in got.items():
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(900), -np.round(s, 12)))[:5]
        found = sorted(found)
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(x - s[i]) < 1e-9 for _, i, x in found)
        hits += len({i for _, i, _ in found} & set(best.tolist()))
    assert hits >= 0.95 * 5 * len(got)
    assert [i for _, i, _ in sorted(got[150])] == [100, 101, 102, 103, 104]


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e-200, 1e-200]), (2, [-3.0, 0.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0]), (50, [0.0, 1e300])]
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in stable_projection.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 3, 0.894427191), (0, 2, 1, 0.707106781), (0, 3, 50, 0.0), (0, 4, 2, -1.0), (50, 1, 1, 0.707106781), (50, 2, 3, 0.447213595), (50, 3, 0, 0.0), (50, 4, 2, -0.0)]


def test_neighbours_on_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert not stable_projection.search(spark.createDataFrame([], kind)).collect()
    assert not stable_projection.search(spark.createDataFrame([(0, [1.0, 0.0])], kind)).collect()
    rows = stable_projection.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], kind)).collect()
    assert [(r.rank, r.vec_id) for r in sorted(rows, key=lambda r: r.rank)] == [(1, 1), (2, 2)]


def test_chi_square_quantile():
    assert abs(stable_projection.chi_square_quantile(0.95, 8) - 15.507) < 1e-3


# --- mixing
def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-9:
        some = [s for s in names if target[s] < 2 * sizes[s] - 1e-9]
        all_weight, over = sum(weight[s] for s in some), 0.0
        for s in some:
            target[s] += left * weight[s] / all_weight
            if target[s] > 2 * sizes[s]:
                over, target[s] = over + target[s] - 2 * sizes[s], 2.0 * sizes[s]
        left = over
    return target


@pytest.mark.parametrize("block", [8, 1024])
def test_mix_meets_targets(make_docs, block):
    rng = random.Random(6)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)), "en", rng.choice(["é", "b", "B", "aa", "hot", "hot", "hot", None])) for i in range(300)] + EDGES
    sizes, docs_size = Counter(), {}
    for i, t, _, s in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes)
    df = make_docs(docs)
    rows = mixing.taken(df, block).collect()
    assert len(rows) == len(docs)
    got = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and abs(r.target - target[r.source]) < 1e-6 * max(1, r.target) and r.source_size == sizes[r.source]
        got[r.source] += r.taken
    assert all(abs(got[s] - t) < 1 for s, t in target.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.taken(df.repartition(7), block).collect()))


def test_schedule_prefixes_are_mixed(spark):
    targets = spark.createDataFrame([(0, "a", 60_000, 60_000.0), (0, "b", 30_000, 30_000.0), (1, "c", 10_000, 10_000.0)], "p int, source string, source_size long, target double")
    slots = [r.source for r in mixing.schedule(targets, 100).orderBy("slot").collect()]
    assert len(slots) == 1000
    for n in (50, 200, 500):
        part = Counter(slots[:n])
        assert all(abs(part[s] - share * n) <= 5 for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)))


def test_mix_of_nothing(make_docs):
    assert not mixing.taken(make_docs(EDGES).limit(0)).collect()
    assert [r.taken for r in mixing.taken(make_docs([(1, None, "en", "s")])).collect()] == [0]


# --- decontamination
def test_leaks_against_brute_force(spark, make_docs, vocabulary):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 5, 20, 37])))) for i in range(30)]
    docs = []
    for _ in range(120):
        w = rng.choices(vocabulary, k=rng.randint(0, 120))
        if rng.random() < 0.5:
            leak = rng.choice(items)[1].upper().split(" ")
            if len(leak) > 25 and rng.random() < 0.3:
                leak[0] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = leak
        docs.append(" ".join(w))
    k = lambda w: min(5, len(w))
    cut = lambda w, n: [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
    names = {i: t.split(" ") for i, t in items}
    df = Counter(s for w in names.values() for s in set(cut(w, k(w))))
    weight = lambda s: round(100 * math.log1p(len(items) / df[s]))
    want = set()
    for d, t in enumerate(docs):
        w = t.lower().split(" ") if t else []
        for i, item in names.items():
            own = set(cut(item, k(item)))
            for s in range(max(1, len(w) - len(item) + 1 + 5)):
                if sum(map(weight, own & set(cut(w[s : s + len(item)], k(item))))) >= 0.8 * sum(map(weight, own)):
                    want.add((d, i))
                    break
    got = decontamination.contaminated(make_docs(docs), spark.createDataFrame(items + [(99, None), (98, " ")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity >= 0.8 and r.distance <= decontamination.RADIUS for r in got)


@pytest.mark.parametrize("cut", [8, 20, 33])
def test_leaks_of_reordered_passages(spark, make_docs, vocabulary, cut):
    """Two parts of an item in the other order share 32 of 36 shingles with it."""
    rng = random.Random(cut)
    item, before, after = (rng.choices(vocabulary, k=k) for k in (40, 30, 30))
    docs = make_docs([" ".join(before + item[cut:] + item[:cut] + after), " ".join(before + item + after), " ".join(before + item[20:] + after + item[:20])])
    got = {r.doc_id: (r.start, round(r.similarity, 2)) for r in decontamination.contaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: (30, 0.89), 1: (30, 1.0)}


def test_leaks_on_edges(spark, make_docs):
    items = spark.createDataFrame([(1, "same text here and there"), (2, "one"), (3, "lost and found again and")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(make_docs(EDGES), items).collect()}
    assert got == {(8, 1), (3, 2), (4, 2), (5, 2), (None, 3)}
    assert decontamination.clean(make_docs(EDGES), items).count() == 4
    assert not decontamination.contaminated(make_docs(EDGES), items.limit(0)).collect()
    assert not decontamination.contaminated(make_docs(EDGES).limit(0), items).collect()


@pytest.mark.parametrize("parts", [1, 2, 3, 8])
def test_leaks_with_null_and_repeated_ids(spark, make_docs, vocabulary, parts):
    """Items and documents that share an id, or have none, each count; the same rows in any partitioning."""
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    a, b, c = text(20), text(25), text(30)
    docs = [(1, text(40), "en", "s"), (1, text(9) + " " + a, "en", "s"), (1, text(9) + " " + a, "en", "s"), (2, b + " " + c, "en", "s"), (None, c, "en", "s"), (None, text(50), "en", "s")]
    items = spark.createDataFrame([(1, a), (7, text(15)), (7, b), (None, c), (None, None), (7, b)], "item_id long, text string")
    got = decontamination.contaminated(make_docs(docs).repartition(parts), items.repartition(parts)).collect()
    assert sorted(((r.doc_id, r.item_id, r.start, r.similarity) for r in got), key=str) == sorted([(1, 1, 9, 1.0), (2, 7, 0, 1.0), (2, None, 25, 1.0), (None, None, 0, 1.0)], key=str)


# --- toxicity
def test_classifier_on_held_out_rows(spark, make_docs, vocabulary):
    rng = random.Random(9)
    bad = {"en": ["idiotic", "scummy"], "de": ["zorklich", "zorkbar"]}
    docs, labels = [], []
    for i in range(1200):
        lang, toxic = rng.choice(["en", "de"]), rng.random() < 0.2
        w = [("x" if lang == "de" else "") + v for v in rng.choices(vocabulary, k=rng.randint(20, 120))]
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad[lang]) + rng.choice(["", ".", ","]))
        docs.append((i, " ".join(w), lang, "s"))
        labels.append((i, 1, int(toxic)))
    df, lab = make_docs(docs + [(None, None, None, None), (5000, "", None, None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.scored(df, lab).collect()
    assert len(rows) == 1202 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert len(held) > 150 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_classifier_trains_on_6000_rows(spark, make_docs, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda words, rows, y, lang: seen.append((len(y), len(lang), len(rows) - 1, len(words), int(y.sum()))) or toxicity.Model())
    docs = [(i, f"word{i} other", "en", "s") for i in range(8000)]
    chosen = toxicity.training_rows(make_docs(docs), spark.createDataFrame([(i, i % 2) for i, *_ in docs], "doc_id long, toxic int"))
    assert chosen.rdd.getNumPartitions() == 1  # the one task that trains
    list(toxicity._train(iter(chosen.toArrow().to_batches(max_chunksize=700))))
    assert seen == [(6000, 6000, 6000, 12000, 3000)]


def test_classifier_knows_every_language():
    """Twenty languages, the rarest with few rows, and rows without one."""
    lang = [f"l{i:02}" for i in range(20) for _ in range(60 - i)] + [None] * 100
    texts = [" ".join(f"{n or 'none'}w{j}" for j in range(r % 7, r % 7 + 12)) + (" vile" if r % 2 else "") for r, n in enumerate(lang)]
    column = pa.chunked_array([pa.array(texts)])
    model = toxicity.train(*toxicity.features(column), np.arange(len(lang)) % 2.0, lang)
    assert model.languages.shape[1] == len(model.thresholds) == 20
    _, guessed = model.logits(*toxicity.features(column))
    assert [guessed[i] for i, n in enumerate(lang) if n] == [int(n[1:]) for n in lang if n]
    alone = toxicity.features(pa.chunked_array([pa.array(["nonew1 nonew2 nonew3"])]))[0][:, 0]
    own = set(toxicity.features(column.slice(0, 60))[0][:, 0].tolist())
    assert all(model.languages[b, 0] == model.languages[:, 0].min() for b in alone.tolist() if b not in own)


def test_conflicting_labels_teach_nothing(spark, make_docs):
    docs = make_docs([f"text {i}" for i in range(40)])
    labels = [(i, t) for i in range(40) for t in ((0, 1) if i % 4 == 0 else (i % 2,))] + [(41, 7), (None, 1)]
    rows = toxicity.training_rows(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = [(f"text {i}", i % 2) for i in range(40) if i % 4 and zlib.crc32(str(i).encode()) % 5]
    assert [(r.text, r.toxic) for r in rows] == want


def test_model_survives_its_bytes():
    texts = [f"good words {i}" + (" vile" if i % 2 else "") for i in range(80)]
    words, rows = toxicity.features(pa.chunked_array([pa.array(texts)]))
    model = toxicity.train(words, rows, np.arange(80) % 2.0, ["en"] * 80)
    again = toxicity.Model.from_bytes(model.to_bytes())
    column = pa.chunked_array([pa.array([*texts, "", "w " * 40_000 + "vile", None])])  # longer than what is scored at once
    assert (model.scores(column) == again.scores(column)).all()
    assert again.scores(column)[-2] > 0.5 > again.scores(column)[-3]


def test_gradients_against_differences():
    """One step of descent moves every parameter against its numerical gradient."""
    texts = [f"a{i % 5} b{i % 3} c{i % 7} d" + (" vile stuff" if i % 2 else "") for i in range(32)]
    words, rows = toxicity.features(pa.chunked_array([pa.array(texts)]))
    y, rng = np.arange(32) % 2.0, np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 0.3, (3, toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 0.3, (toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS)), rng.normal(0, 0.1, 24), rng.normal(0, 0.5, 24))

    def loss(m):
        z = m.responses(m.embed(words), rows)
        top = np.maximum(0, np.array([z[a:b].max(axis=0) for a, b in zip(rows[:-1], rows[1:])]))
        p = 1 / (1 + np.exp(-(top @ m.weight + m.bias)))
        return float(np.mean(-y * np.log(p) - (1 - y) * np.log(1 - p)))

    before = {n: getattr(model, n).copy() for n in ("filters", "offset", "weight")}
    slope = {}
    for name, at in (("weight", (3,)), ("weight", (17,)), ("offset", (1,)), ("offset", (9,)), ("filters", (2, 0)), ("filters", (5, 20)), ("filters", (0, 40))):
        array, eps = getattr(model, name), 1e-5
        array[at] += eps
        up = loss(model)
        array[at] -= 2 * eps
        slope[name, at] = (up - loss(model)) / (2 * eps)
        array[at] += eps
    old = toxicity.EPOCHS
    toxicity.EPOCHS = 1
    try:
        toxicity._descend(model, words, rows, y, np.arange(32), np.random.default_rng(2))
    finally:
        toxicity.EPOCHS = old
    for (name, at), g in slope.items():
        if abs(g) > 1e-3:
            assert np.sign(getattr(model, name)[at] - before[name][at]) == -np.sign(g), (name, at)


def test_classifier_without_labels(spark, make_docs):
    rows = toxicity.scored(make_docs(EDGES), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(EDGES) and all(r.predicted == 0 for r in rows)


# --- token files
def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 1024):
        for values in (rng.integers(0, 50, n), rng.integers(0, 1 << 32, n), np.zeros(n), np.where(rng.random(n) < 0.05, 60_000, rng.integers(500, 520, n)), np.full(n, (1 << 32) - 1)):
            v = values.astype(np.uint32)
            block = token_files.encode_block(v)
            assert (token_files.decode_block(memoryview(block), n) == v).all()
    skewed = np.where(np.arange(1024) % 100 == 0, 60_000, 7).astype(np.uint32)
    assert len(token_files.encode_block(skewed)) < 200  # outliers don't widen the block
    with pytest.raises(ValueError):
        token_files.read_segment(b"none of ours")


def test_token_files_against_the_library(make_docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = [*EDGES[:6], (7, "w " * 3000 + "end", "en", "b"), (11, "A <|STARTOFTEXT|> b <|endoftext|>. It's, IT'S; €uro § 12ab É, é.", "en", "s"), (9, "ΑΣ ΣΑΣ İ x \x1c a\x85b ¤ ¤¤", "fr", "s"), (-3, "minus", "en", "s")]
    got = token_files.round_trip(make_docs(docs), path).collect()
    start = 0
    for (i, text, *_), row in zip(sorted(docs), sorted(got, key=lambda r: r.start), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not token_files.round_trip(make_docs(EDGES).limit(0), path).collect()
    assert len(token_files.round_trip(make_docs(EDGES), path).collect()) == len(EDGES)


def test_vocabularies_that_keep_white_space(make_docs):
    """Any vocabulary file gives the library's ids."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    assert token_files.drops_space(public.path("word_bpe_49k.json"))
    path = public.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    assert not token_files.drops_space(path)
    docs = [(i, t, "en", "s") for i, t in enumerate(["two  spaces", "a\nb", None, "", " x "])] + [(1, "again", "en", "s")]
    got = token_files.round_trip(make_docs(docs), path).collect()
    want = sorted((i, zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t, *_ in docs)
    assert sorted((r.doc_id, r.ids_crc32) for r in got) == want
