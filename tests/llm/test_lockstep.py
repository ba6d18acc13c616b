import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from oddsloom.llm import lockstep
from oddsloom.llm.subword import byte_level

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Tokens by the libraries; spans, groups and links by comparing all tokens of a text with each other."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True

    def spans(widths):
        ends = np.cumsum(widths).tolist()
        return list(zip([0, *ends[:-1]], ends))

    def piece(i):
        name = b_tok.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if b_tok.is_byte(i) else name.replace("▁", " ").encode()

    def one(text):
        if not text:
            return None
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
        a_bytes, b_bytes = [byte_level(a_tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        sa, sb = spans(list(map(len, a_bytes))), spans(list(map(len, b_bytes)))
        links = [(i, j) for i, (x, y) in enumerate(sa) for j, (u, v) in enumerate(sb) if x < v and u < y]
        cuts = sorted({y for _, y in sa} & {v for _, v in sb})
        ids = lambda ids, s, lo, hi: ",".join(str(t) for t, (x, _) in zip(ids, s) if lo <= x < hi)
        groups = ";".join(f"{ids(a, sa, lo, hi)}|{ids(b, sb, lo, hi)}" for lo, hi in zip([0, *cuts], cuts))
        return a, b, links, cuts, groups

    return one


def wanted(texts, one):
    """Rows of the query by counting plainly."""
    made = [one(t) for t in texts]
    counts = Counter(p for m in made if m for p in {(m[0][i], m[1][j]) for i, j in m[2]})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    for m in made:
        if m is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, links, cuts, groups = m
            each = [(a[i], b[j]) for i, j in links]
            yield len(a), len(b), len(cuts), len(links), sum(counts[p] == top[p[0]] for p in each), sum(counts[p] for p in each), hashlib.sha256(groups.encode()).hexdigest()


def texts_of(seed, n):
    r = random.Random(seed)
    letters = " abcdefghijklmnopqrstuvwxyzTHE  \n\t.,-éñß好🧿019'$"
    return ["".join(r.choice(letters) for _ in range(r.randrange(70))) for _ in range(n)]


SPECIAL = [None, "", " ", "   ", "▁", "a▁b", "\x00", "<|endoftext|>", "</s><s>", "é", "好好", "🧿" * 9, "naïve café. The", "  two  spaces ", "a" * 400, "don't they'll", "Â b", "x  y"]


def test_lanes_give_what_one_lane_gives(plain):
    aligner = lockstep.Aligner(A, B)
    texts = SPECIAL + texts_of(1, 300) + [" ".join(texts_of(2, 80)), "nospacehere" * 50]
    a, b = aligner.encode(pa.array(texts, pa.string()))
    whole = [np.sort(x) for x in lockstep.align(a, b, 10**9)]
    for size in (1, 3, 40):
        assert len(lockstep.lanes(a, b, size)[0]) > (np.diff(a.offsets) > 0).sum()
        for x, y in zip(lockstep.align(a, b, size), whole):
            assert np.array_equal(np.sort(x), y)


def test_detail_equals_comparing_all_tokens(spark, plain):
    texts = SPECIAL + texts_of(3, 200)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["id"]: r for r in lockstep.alignments(frame, A, B).collect()}
    assert len(found) == len(texts)
    for k, t in enumerate(texts):
        r, m = found[k], plain(t)
        if m is None:
            assert r["a_ids"] == r["b_ids"] == r["link_a"] == r["cuts"] == r["pairs"] == [] and r["groups_sha256"] == ""
        else:
            assert (r["a_ids"], r["b_ids"], list(zip(r["link_a"], r["link_b"])), r["cuts"]) == m[:4]


SHAPE = "doc_id long, text string, row int, pair int, n string, id int, pairs int, best int"


@pytest.mark.parametrize("hot", [0, 50, 10**6])
def test_scores_equal_plain_counts(spark, plain, hot):
    texts = SPECIAL + texts_of(4, 150) + ["The same text, the same text."] * 25
    rows = [(k, t, 1, 1, "x", 1, 1, 1) for k, t in enumerate(texts)]
    found = lockstep.alignment_scores(spark.createDataFrame(rows, SHAPE).repartition(4), A, B, hot_pairs=hot).collect()
    assert [tuple(r)[1:] for r in sorted(found)] == list(wanted(texts, plain))


def test_long_texts_rows_without_id_and_no_rows(spark, plain, tmp_path, prose):
    texts = ["Long text " + "with words, " * 2000, prose(1, 300), prose(1, 300)]
    rows = [(None, texts[0], 1, 1, "x", 1, 1, 1), (7, texts[1], 1, 1, "x", 1, 1, 1), (7, texts[2], 1, 1, "x", 1, 1, 1)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/a/documents.parquet")
    found = lockstep.op13_cross_tokenizer_alignment(spark, f"{tmp_path}/a")
    assert set(found.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(wanted(texts, plain))
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert lockstep.op13_cross_tokenizer_alignment(spark, f"{tmp_path}/b").count() == 0
