import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from oddsloom.llm import piece_codec as pc

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_and_texts_as_the_library(library):
    r = random.Random(3)
    texts = [None, "", " ", "   ", "  x", "a  b ", "\n\n", "▁▁a", "\x00", "好 🧿", "<0x0A></s><s>", " " * 333, "x" * 5000, "naïve café. The", "Then, at  last\tone"]
    letters = " abcdefghijklmnopqrstuvwxyzTHE  \n.,-▁éñß好🧿019"
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(3000)]
    model = pc.PieceModel(PATH)
    ids, offsets = model.encode(pa.array(texts))
    decoded = model.decode(ids, offsets)
    for i, t in enumerate(texts):
        wanted = library.encode(t or "", add_eos=True)
        assert ids[offsets[i] : offsets[i + 1]].tolist() == wanted
        assert decoded[i].decode() == library.decode(wanted)


def test_decodes_broken_bytes_like_the_library(library):
    import numpy as np

    model = pc.PieceModel(PATH)
    for ids in ([3 + 0xE2, 3 + 0x82], [264, 3 + 0xFF, 264], [3 + 0xE2, 3 + 0x82, 3 + 0xAC, 2], [29871, 3 + 0xC3], [2], []):
        found = model.decode(np.array(ids, dtype=np.int32), np.array([0, len(ids)], dtype=np.int64))[0]
        assert found.decode() == library.decode(ids)


def test_table(spark, library):
    rows = [(1, "hello world", 9), (1, "hello world", 9), (2, None, 1), (None, "x", 2), (3, "word " * 30_000, 5)]
    found = pc.token_columns(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert len(found) == 5
    for r in found:
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        wanted = library.encode(text, add_eos=True)
        assert r["ids"] == wanted and r["n_tokens"] == len(wanted)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, wanted)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(wanted).encode()).hexdigest()
    encoded = pc.encode_texts(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH)
    assert {(r["id"], r["text"]) for r in pc.decode_ids(encoded, PATH).collect()} == {(i, t or "") for i, t, _ in rows}
    assert pc.token_columns(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_thrift_remembers_less_and_changes_no_id(spark, library):
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(300)) for _ in range(60)]
    model = pc.PieceModel(PATH, thrift=1000)
    for k in range(0, 60, 2):
        ids, offsets = model.encode(pa.array(texts[k : k + 2]))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == library.encode(texts[k : k + 2], add_eos=True)
        assert len(model.known) <= pc.KNOWN // 1000 and len(model.pairs) <= pc.PAIRS // 1000 + 1
    rows = spark.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string")
    wide, close = (sorted(pc.token_columns(rows, PATH, thrift=k).collect()) for k in (1, 4))
    assert wide == close and len(close) == 62
