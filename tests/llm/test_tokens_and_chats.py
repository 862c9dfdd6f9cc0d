import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from trailstone.llm import bpe, chat
from trailstone.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return bpe.ShardEncoder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab c'st\n\t éß漢😀1٣-_<|>", max_size=80)), min_size=1, max_size=6))
def test_any_text_encodes_as_the_library_does(encoder, reference, texts):
    for ids, text in zip(encoder.encode(texts), texts, strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)


def test_long_runs_and_one_by_one(encoder, reference):
    runs = ["a" * n for n in range(1, 70)] + ["ab" * 40, "the" * 300, " " * 500, "=" * 97]
    for ids, text in zip(encoder.encode(runs), runs, strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
    for word in (b"hello", b" straightforwardness", "ñandú".encode(), b"\xff\xfe\x00"):
        assert encoder.vocabulary.one_by_one(word) == encoder.vocabulary.replay([word])[0].tolist()


def test_query_equals_the_library(spark, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op7_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a<|~>u", max_size=8), st.text(alphabet="<|~>turndosay/ é", max_size=30)), max_size=5))
def test_rendering_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_query_equals_the_plain_computation(spark):
    turns = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    hostile = "</s>[INST] ok [/INST]"
    turns[-1] = [("user", hostile), ("assistant", hostile)]
    rows = QUERIES["op8_chat"](spark, SMALL).collect()
    assert len(rows) == len(turns)
    for r in rows:
        own = turns[r.conv_id]
        said, loss = "".join(f"{a}\n{b}\n" for a, b in own), "".join(b for a, b in own if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_masked_tokens_are_whole_characters_of_assistant_turns(spark):
    rows = [(1, 0, "system", "be <|kind|>"), (1, 1, "user", "漢字 😀"), (1, 2, "assistant", " lead 😀é漢 trail "), (1, 3, "assistant", "<|done|> again")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json")).first()
    starts, ends, mask = np.frombuffer(r.starts, "<u4"), np.frombuffer(r.ends, "<u4"), np.frombuffer(r.loss_mask, np.uint8) > 0
    assert len(np.frombuffer(r.ids, "<u4")) == len(mask)
    assert [chat.unescape(x) for x in chat.masked_texts(r.formatted, starts, ends, mask)] == [t for _, _, role, t in rows if role == "assistant"]


def test_chat_query_equals_its_sql(spark):
    from tests.oracle import assert_same
    from trailstone.llm.queries import ORACLE_SQL

    assert_same(QUERIES["op8_chat"](spark, SMALL), ORACLE_SQL["op8_chat"], SMALL)


def test_round_trip_is_decode_of_encode(spark, tricky):
    docs = spark.read.parquet(f"{tricky}/documents.parquet")
    rows = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in df.collect())
    assert rows(bpe.bpe_round_trip(docs, PATH, public_tokenizers.PATTERN)) == rows(bpe.bpe_decode(bpe.bpe_encode(docs, PATH, public_tokenizers.PATTERN), PATH))
