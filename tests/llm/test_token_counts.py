import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import EDGES
from gridmeter.llm import queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = token_counts.transducer(PATH)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def agree(texts):
    assert OWN.count(pa.array(texts, pa.string())).tolist() == library(texts)


def test_pieces_and_special_tokens():
    agree(["don't", "'s'abc !'s", "'rex 're3 ''s 'v 'l 'lla 'll", "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "12½² ٣", "a\x85b\xa0c　d​e\x1c", "", None, "'", "I'LL WE'VE"])


def test_normalization():
    agree(["Ångström K İ ẞ", "́ x ́̀y", "ǅ ﬁ ΑΣ", "été", "été<|endoftext|>́"])


@pytest.mark.parametrize("letters", ["ab'", "aaaaan", "the quick", "0a'!é日", "<|endoftx>"])
def test_random_texts(letters):
    rng = random.Random(letters)
    agree(["".join(rng.choices(letters, k=rng.randint(1, 2000))) for _ in range(150)])


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text(texts):
    agree(texts)


def test_chunks_inside_long_words():
    """Entry states are not known where a chunk starts inside a word; maps compose."""
    agree([piece * n for piece in ("a", "th", "é", "日本", "🙂", ".", "'s", "1") for n in (255, 256, 257, 512, 1024, 3001)] + ["x" * 100 + " " + "ab" * 4000 + " y" * 700])


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KEPT", 500)
    own = token_counts.Transducer(PATH)
    texts = ["some words of a text", "and some others; 12 of them", "zzz" * 90]
    for _ in range(3):
        assert own.count(pa.array(texts)).tolist() == library(texts)


def test_growing_table():
    own = token_counts.Transducer(PATH)
    own._grow(1)
    before = own.count(pa.array(["several words that are met again"])).tolist()
    own._grow(own.n_keys)
    known = own.n_keys
    assert own.count(pa.array(["several words that are met again"])).tolist() == before and own.n_keys == known


def test_rows(spark, make_docs):
    docs = make_docs([*EDGES, (9, "z " * 2048, "en", "s"), (10, "z " * 2049, "en", "s")])
    got = token_counts.counts(docs, PATH)
    want = sorted(((d[0], len((d[1] or "").encode()), n, n > 2048) for d in [*EDGES, (9, "z " * 2048), (10, "z " * 2049)] for n in library([d[1]])), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert token_counts.counts(docs.limit(0), PATH).count() == 0


def test_query(spark):
    rows = queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(texts, library(texts.values()), strict=True))


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="no vocabulary"):
        token_counts.Transducer(public_tokenizers.path("byte_bpe_50k.json"))
