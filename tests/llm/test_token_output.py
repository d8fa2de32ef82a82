import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import documents, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import token_output
from sparkloom.llm.kernel import string_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = token_output.Encoder(PATH)
LIBRARY = Tokenizer.from_file(PATH)


def encoded(texts):
    import pyarrow as pa

    ids, ends = ENCODER(*string_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sé1 \n\t\x0b\x1c\u00a0\u2003\u3000“_.漢\x00"), max_size=20), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    assert encoded(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_with_a_small_memory(monkeypatch):
    monkeypatch.setattr(token_output, "MEMORY", 3)
    rng = random.Random(1)
    for _ in range(5):
        texts = [" ".join(words(rng, 20)) + ".\nEnd 12 <|endoftext|>" for _ in range(4)]
        assert encoded(texts) == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_memory_is_bounded_in_ids_too(monkeypatch):
    """Units of very many ids: what is kept of them follows their ids, not their number."""
    monkeypatch.setattr(token_output, "MEMORY", 100)
    rng, encoder, own = random.Random(3), token_output.Encoder(PATH), []
    again = "".join(words(rng, 500))
    for _ in range(6):
        texts = [again + "0 " + "".join(words(rng, 500)) + " " + again + "1 tail " + again + "0" for _ in range(2)]
        ids, ends = encoder(*string_bytes(pa.array(texts, pa.string())))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
        own.append(len(ids))
    assert len(encoder.keys) <= 100 and len(encoder.ids) <= 8 * 100 + max(own)


def test_special_tokens_are_the_librarys():
    """The contract asks for the library's ids without further settings: a special token's literal is that token."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n<|endoftext|><|endoftext|>", "<|endof", "text|> plain", "no token here"]
    got = encoded(texts)
    assert got == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0] == [64, 220, 50256, 275] and got[1] == [50256]


@pytest.mark.parametrize("vocabulary", [1, 2, 50, 257, 50257, 65536, 65537, 200_000])
def test_packing_round_trip_and_random_access(vocabulary):
    bits = token_output.width(vocabulary)
    assert (1 << bits) >= vocabulary > (1 << (bits - 1)) or bits == 1
    ids = np.random.default_rng(bits).integers(0, vocabulary, 777)
    packed = token_output.pack(ids, bits)
    assert len(packed) == -(-777 * bits // 8)
    for a, b in ((0, 777), (1, 2), (333, 700), (776, 777), (5, 5)):
        assert (token_output.unpack(packed, bits, a, b) == ids[a:b]).all()


def test_files_hold_every_document_in_order(spark):
    rng = random.Random(2)
    rows = [(k * 3, " ".join(words(rng, rng.randint(0, 60)))) for k in range(150)] + odd_rows()
    got = token_output.token_output(documents(spark, rows).repartition(5), PATH, 2, block=500).orderBy("start").collect()
    assert len(got) == len(rows) and [r["doc_id"] for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    texts, at = {}, 0
    for d, t in rows:
        texts.setdefault(d, []).append(np.array([*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        assert r["start"] == at and any((r["n_tokens"], r["ids_crc32"]) == (len(x), zlib.crc32(x.tobytes())) for x in texts[r["doc_id"]])
        at += r["n_tokens"]
    assert token_output.token_output(documents(spark, []), PATH, 2).count() == 0
