import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from oddsloom.llm import packing
from oddsloom.llm.subword import Subwords

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name, spaced, plain", [("word_bpe_49k.json", True, False), ("byte_bpe_50k.json", False, True)])
def test_same_ids_as_the_library(name, spaced, plain):
    r = random.Random(5)
    letters = " abcdefgTHESIs's'll  \n\t\r\v\f.,-▁éñß好🧿019  \u0085　́가\x1c\x1f <|endoftext|>ΣςİIÅ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(6000)]
    texts += ["a<|endoftext|>b", "<|endoftext|> x", "x " * 5, " ", "", "a  b", " \n a", "it's we'll  can't", "7 0 1 0123456789 0", "x" * 3000]
    texts += [" ".join(r.choice(["<|endoftext|>", "don't", "Á", "́", "Σ", "x y", " ", "\n", "a=b</p>"]) for _ in range(8)) for _ in range(2000)]
    words, library = Subwords(public_tokenizers.path(name), spaced, plain), Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = plain
    for k in range(0, len(texts), 700):
        ids, offsets = words.encode(pa.array(texts[k : k + 700]))
        for i, t in enumerate(texts[k : k + 700]):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_first_fit_equals_a_scan_over_all_bins():
    r = random.Random(2)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted((r.randrange(1, 100) for _ in range(n)), reverse=True)
        free, wanted = [], []
        for item, size in enumerate(sizes):
            k = next((k for k, f in enumerate(free) if f >= size), len(free))
            if k == len(free):
                free.append(100)
                wanted.append([])
            free[k] -= size
            wanted[k].append([item, 0, size])
        assert packing.first_fit(sizes, 100) == wanted


def test_topping_up_leaves_no_padding_and_cuts_little():
    r = random.Random(4)
    sizes = sorted((r.randrange(1, 2048) for _ in range(500)), reverse=True)
    bins = packing.topped_up(packing.first_fit(sizes, 2048), 2048)
    used = [sum(b - a for _, a, b in pieces) for pieces in bins]
    assert sum(used) == sum(sizes) and all(u.bit_count() == 1 for u in used) and sum(u < 2048 for u in used) <= 11
    parts = defaultdict(list)
    for pieces in bins:
        for item, a, b in pieces:
            assert a < b
            parts[item].append((a, b))
    for item, found in parts.items():
        found.sort()
        assert found[0][0] == 0 and found[-1][1] == sizes[item] and all(x[1] == y[0] for x, y in zip(found, found[1:]))
    assert sum(len(p) - 1 for p in parts.values()) <= len(bins)


SHAPE = "doc_id long, text string, ids string, start int, id int, tokens int, place int, bin_group int"


def test_every_id_lies_in_one_piece(spark, prose):
    library = Tokenizer.from_file(PATH)
    texts = [None, "", " \n", "<|endoftext|> plain", "Very long " * 30_000] + [prose(k, 1 + k * 37 % 900) for k in range(150)] + ["Same text"] * 60
    rows = [(k if k % 50 else None, t, "x", 1, 2, 3, 4, 5) for k, t in enumerate(texts)]
    pieces = packing.packed_pieces(spark.createDataFrame(rows, SHAPE).repartition(3), PATH, group_documents=64).cache()
    found = [r.asDict() for r in pieces.collect()]
    wanted = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(texts)}
    # Rows without an id are told apart by what they hold.
    by_row, blank = defaultdict(list), {tuple(wanted[k]): k for k in range(0, len(texts), 50)}
    for r in found:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        if r["id"] is not None:
            by_row[r["id"]].append(r)
    assert sum(r["length"] for r in found if r["id"] is None) == sum(map(len, blank))
    for k, ids in wanted.items():
        if k % 50:
            own = sorted(by_row[k], key=lambda r: r["start"])
            assert [i for r in own for i in r["ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
            assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
        assert sum(r["length"] for r in own).bit_count() == 1 and sum(r["length"] for r in own) <= 2048
    whole = {r["sequence_id"]: r for r in packing.sequences(pieces).collect()}
    assert whole.keys() == by_sequence.keys()
    for k, own in by_sequence.items():
        assert whole[k]["ids"] == [i for r in own for i in r["ids"]]


def test_padding_and_empty_table(spark):
    pieces = spark.createDataFrame([(1, 0, [5, 6]), (1, 2, [7]), (2, 0, [8, 9])], "sequence_id long, offset long, ids array<int>")
    assert sorted((r["sequence_id"], r["ids"], r["n_tokens"]) for r in packing.sequences(pieces, 6).collect()) == [(1, [5, 6, 7, 0, 0, 0], 3), (2, [8, 9], 2)]
    assert packing.packed_pieces(spark.createDataFrame([], SHAPE), PATH).count() == 0


def test_query(spark, tmp_path):
    spark.createDataFrame([(k, "word " * (k * 40), "e", 1, 1, 1, 1, 1) for k in range(100)], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    found = packing.op12_packing(spark, str(tmp_path))
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.groupBy().sum("length").first()[0] == sum(k * 40 + 1 for k in range(100))
