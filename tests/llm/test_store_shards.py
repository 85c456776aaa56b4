import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm.bpe import Encoder, vocabulary
from weftline.llm.sharding import shard_documents
from weftline.llm.token_store import TokenFile, pack_file, store_documents


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70_000), max_size=1500))
def test_any_token_is_addressed(ids):
    f = TokenFile(pack_file([7, None], [len(ids), 0], np.array(ids, np.uint32)))
    assert f.doc_ids == [7, None] and f.all().tolist() == ids
    assert [f.token(i) for i in range(0, len(ids), 7)] == ids[::7]


TEXTS = ["Hello World's it'll don't <|endoftext|> x", "", "été ÉTÉ İstanbul ﬁ", "a1b22 ... !!! $$ über, straße.", "漢字 かな 🙂🙂 ​  x\x00y", "tab\tnew\nline\x0bv\x85n s", "word " * 300, "H\u0331 h\u0331 I\u0307 A\u0301b", "a<|startoftext|>b <|ENDOFTEXT|> <|endoftext|><|endoftext"]


def test_encoders_equal_the_library():
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        enc = Encoder(vocabulary(path))
        for _ in range(2):  # the second time from memory
            got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(TEXTS)]
            assert got == [t.encode(x, add_special_tokens=False).ids for x in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.characters(max_codepoint=0x250), max_size=40) | st.text("aB.,&-_²'é 1|<>", max_size=30))
def test_encoders_on_any_text(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t, enc = _pair(name)
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def _pair(name, _kept={}):
    if name not in _kept:
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        _kept[name] = t, Encoder(vocabulary(path))
    return _kept[name]


def test_store(spark):
    rows = list(enumerate(TEXTS)) + [(100, None)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    t, _ = _pair("word_bpe_49k.json")
    at, want = 0, []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store_documents(df).collect()) == want
    assert store_documents(df.limit(0)).count() == 0


def test_shards(spark):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(2000)] + [(5, None), (5, "é"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shard_documents(df, 24).collect()
    total, slots = [0] * 24, [[] for _ in range(24)]
    for r in got:
        total[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(total) - min(total) <= 2 * 510
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 5 and r.size < 20} == {(8, 0), (10, zlib.crc32("é".encode()))}
    assert shard_documents(df.limit(0), 24).count() == 0


def test_shards_equal_sql(spark):
    from compare import connect, rows_of
    from conftest import SMALL

    from weftline.llm.queries import ORACLE, QUERIES

    df, want = QUERIES["op6_sharding"](spark, SMALL), connect(SMALL).sql(ORACLE["op6_sharding"])
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), want.columns)
