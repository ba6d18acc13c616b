"""SentencePiece encoding and decoding (merge type, byte fallback) of whole texts.

For every prefix of a word, the last token of the prefix's encoding is unique.
An automaton over the vocabulary finds all tokens that end at a place; of
these, the one is stored whose neighbour, the stored last token of the prefix
before it, is compatible with it: merging their joint text by rank would leave
the border between the two. The ids are then read off backwards. No merge is
ever simulated on a text, and the work grows linearly with it.

Texts are cut before spaces, as no token has a space after another character;
a task encodes each distinct part once and keeps its ids in arrays. Runs of
spaces, whose tokens share one rank, are merged by length.

Edge cases: a null text is an empty text, whose ids are the end id alone;
characters outside the vocabulary become byte tokens; texts of any length are
read whole; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored; a null id is kept.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsloom.llm import arrowtext as at
from oddsloom.llm.subword import KNOWN, KnownParts

SPACE = "▁"
#: Pairs of tokens that a task remembers.
PAIRS = 150_000
#: Ids of one step: what its arrays hold is bounded by it.
SLICE_BYTES = 1 << 20


class PieceModel(KnownParts):
    """A merge-type vocabulary: ranks, splits, the automaton and the pair test."""

    def __init__(self, path: str, thrift: int = 1):
        import ahocorasick
        import sentencepiece

        self.remembered, self.remembered_pairs = KNOWN // thrift, PAIRS // thrift
        source = sentencepiece.SentencePieceProcessor(model_file=path)
        size = source.vocab_size()
        self.end = source.eos_id()
        self.special = {i for i in range(size) if source.is_control(i) or source.is_unknown(i)}
        self.byte_ids, self.text = [0] * 256, [""] * size
        self.byte_of: dict[int, int] = {}
        scores: dict[int, float] = {}
        for i in range(size):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
            elif i not in self.special:
                self.text[i], scores[i] = piece, source.get_score(i)
        self.id_of = {self.text[i]: i for i in scores}
        # Smaller ranks merge earlier; tokens of one score share a rank.
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {t: order[scores[i]] for t, i in self.id_of.items()}
        self.known_characters = {t for t in self.id_of if len(t) == 1}
        self.unknown = re.compile("([^" + "".join(map(re.escape, sorted(self.known_characters))) + "])")
        #: When a token comes into being, and the two tokens it is made of; single characters are there from the start.
        self.born: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            if set(text) == {SPACE} and len(text) > 1 or not self.known_characters.issuperset(text):
                continue
            if len(text) > 1:
                merged, last = self.merge(text)
                if merged != [text]:
                    continue  # never the encoding of its own text, so never in any
                self.halves[i] = (self.id_of[last[0]], self.id_of[last[1]])
            self.born[i] = self.rank[text] if len(text) > 1 else -1
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.forget()
        self.space_runs: dict[int, tuple[int, ...]] = {}
        self.lone_space = self.id_of.get(SPACE)
        surface = [bytes([self.byte_of[i]]) if i in self.byte_of else self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        self.surface = pa.array(surface, pa.binary())
        self.decimal = pa.array([b"%d " % i for i in range(size)], pa.binary())
        self.is_byte = np.array([i in self.byte_of for i in range(size)])

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merging by rank, leftmost first, as the vocabulary defines it; used on vocabulary items and runs of spaces."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        heap: list[tuple[int, int, int, str]] = []
        last = None

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(symbols)
            if i >= 0 and j < len(symbols):
                joined = symbols[i] + symbols[j]
                if joined in self.rank:
                    heapq.heappush(heap, (self.rank[joined], i, j, joined))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != joined:
                continue
            last = (symbols[i], symbols[j])
            symbols[i], symbols[j] = joined, None
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None], last

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the texts of two tokens side by side leaves just these two.

        Time is run backwards. Whichever token came last is taken apart; the
        part at the border then stood there until that moment, so a token
        across the border with an earlier rank would have been made first. Of
        equal ranks the left one is made first.
        """
        left, right, text, born = a, b, self.text, self.born
        until, fits = 1 << 60, True
        while True:
            across = self.rank.get(text[left] + text[right])
            if across is not None and across < until:
                fits = False
                break
            if born[left] > born[right]:
                until, left = born[left], self.halves[left][1]
            elif born[right] >= 0:
                until, right = born[right] + 1, self.halves[right][0]
            else:
                break
        if len(self.pairs) > self.remembered_pairs:
            self.pairs.clear()
        self.pairs[a << 32 | b] = fits
        return fits

    def segment(self, text: str) -> list[int]:
        """Ids of a text of known characters: the prefix table, then the way back."""
        last = [-1] * len(text)
        length = [0] * len(text)
        known, compatible = self.pairs.get, self.compatible
        for end, (i, n) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            if end >= n:
                before = last[end - n]
                if before < 0:
                    continue
                fits = known(before << 32 | i)
                if fits is None:
                    fits = compatible(before, i)
                if not fits:
                    continue
            last[end], length[end] = i, n
        ids, end = [], len(text) - 1
        while end >= 0:
            ids.append(last[end])
            end -= length[end]
        ids.reverse()
        return ids

    def word(self, text: str) -> list[int]:
        """Ids of a word with the space before it, or of a part of one."""
        if self.known_characters.issuperset(text):
            return self.segment(text)
        ids: list[int] = []
        for k, part in enumerate(self.unknown.split(text)):
            if k % 2:
                ids += [self.byte_ids[x] for x in part.encode()]
            elif part:
                ids += self.segment(part)
        return ids

    def spaces(self, n: int) -> tuple[int, ...]:
        if n not in self.space_runs:
            self.space_runs[n] = tuple(self.id_of[t] for t in self.merge(SPACE * n)[0]) if n else ()
        return self.space_runs[n]

    def parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return self.bytes_cut(texts, lambda before, after: (after == 32) & (before != 32))

    def encode_new(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [self.part(p.decode()) for p in parts.to_pylist()]
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return lengths, np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(lengths.sum()))

    def part(self, text: str) -> list[int]:
        """Ids of a run of spaces and the word behind it: of several spaces the last is the word's, unless it stays a token by itself."""
        word = text.lstrip(" ")
        n = len(text) - len(word)
        if not word:
            return list(self.spaces(n))
        ids = self.word(SPACE + word)
        if n == 1:
            return ids
        return [*self.spaces(n), *ids[1:]] if ids[0] == self.lone_space else [*self.spaces(n - 1), *ids]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id included, and row offsets."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        ids, offsets = super().encode(spaced)
        # The end id after each row's ids.
        return np.insert(ids, offsets[1:], self.end), offsets + np.arange(len(offsets))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts in UTF-8 of the ids of each row."""
        taken = pc.take(self.surface, pa.array(ids))
        at_byte = np.frombuffer(taken.buffers()[1], dtype=np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, dtype=np.int32)
        data = taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] else b""
        cuts = at_byte[offsets]
        found = []
        for row, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            text = data[a:b]
            try:
                text.decode()
            except UnicodeDecodeError:
                text = self.repaired(ids[offsets[row] : offsets[row + 1]])
            found.append(text[1:] if text[:1] == b" " and not self.is_byte[ids[offsets[row]]] else text)
        return found

    def repaired(self, ids: np.ndarray) -> bytes:
        """As ``decode``, where byte tokens don't make up characters: each such byte is U+FFFD."""
        out, held = [], bytearray()

        def flush() -> None:
            while held:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(held[:n]).decode().encode())
                        del held[:n]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    del held[:1]

        for i in ids.tolist():
            if i in self.byte_of:
                held.append(self.byte_of[i])
            else:
                flush()
                out.append(self.surface[i].as_py())
        flush()
        return b"".join(out)


def with_model(path: str, step: Callable[[PieceModel, pa.RecordBatch], Iterator[pa.RecordBatch]], thrift: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that reads the model once and gives its memory back at its end: a worker outlives its tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or PieceModel(path, thrift)
            yield from step(model, batch)
        del model
        at.release()

    return run


def encode_texts(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids)``: the token ids of every text, the end id last."""
    at.small_batches(documents.sparkSession)

    def step(model: PieceModel, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batch, "text", SLICE_BYTES):
            ids, offsets = model.encode(part.column("text"))
            yield pa.record_batch({"id": part.column("id"), "ids": at.list_array(ids, offsets, pa.int32())})

    return documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(with_model(path, step), "id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """``(id, text)`` of rows ``(id, ids)``."""
    at.small_batches(encoded.sparkSession)

    def step(model: PieceModel, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, lengths = batch.column("ids").flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
        texts = model.decode(ids.astype(np.int32), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        yield pa.record_batch({"id": batch.column("id"), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return encoded.select("id", "ids").mapInArrow(with_model(path, step), "id long, text string")


def token_columns(documents: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = True, thrift: int = 1) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and, if wanted, ``ids``: every text encoded, and its ids decoded, in one pass.

    ``thrift`` divides what a task remembers and how much text it takes at a
    time: less memory, more work, the same ids.
    """
    at.small_batches(documents.sparkSession)

    def step(model: PieceModel, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in at.slices(batch, "text", max(1, SLICE_BYTES // thrift)):
            ids, offsets = model.encode(part.column("text"))
            decimal = pc.take(model.decimal, pa.array(ids))
            cuts = np.frombuffer(decimal.buffers()[1], dtype=np.int32)[offsets].tolist()
            data = memoryview(decimal.buffers()[2])
            made = {
                id_column: part.column("id"),
                "n_tokens": pa.array(np.diff(offsets), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(data[a : b - 1]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in model.decode(ids, offsets)]),
            }
            if keep_ids:
                made["ids"] = at.list_array(ids, offsets, pa.int32())
            yield pa.record_batch(made)

    kind = f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(with_model(path, step, thrift), kind)


def op4_piece_encoding(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_columns(documents, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)
