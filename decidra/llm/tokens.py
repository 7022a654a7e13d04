"""Token counts: texts are encoded in batches inside Arrow functions, and only lengths come back.

Batches hold about BATCH bytes whatever the number of texts, so short and long texts take about as much memory.
Texts over PART bytes are cut into parts of about that size first, and the parts are dealt by hash, so a long text is
counted by many tasks and every part weighs about the same.

A cut is made only where it can't change a token. In a sentencepiece model that leaves texts as they are, no piece
crosses a place whose two characters stand side by side in no piece of the vocabulary. Before a blank the part starts
behind it, as the library puts one in front of each text itself; elsewhere the part gets a line end in front, which is in no
piece, and the tokens of that are taken off. In a batch texts are cut before blanks in the same way, and each distinct unit is
encoded once. The texts of tokenizers files are cut between an ASCII letter and a blank with a letter behind it, where
their pre-tokenizers start a new word. A text or unit without such a place stays whole.

Defined cases: null and empty texts have no tokens; strings of special tokens inside a text are handled as the library does by
default; rows of the same text or doc_id are separate rows; columns other than _rid, doc_id and text are not read, so
names can't clash; an empty table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a batch that is encoded at once, bytes over which a text is cut, and distinct units whose lengths a worker keeps.
BATCH, PART, MEMO = 1 << 20, 1 << 18, 200_000
BLANK = "▁"


class SentencePieces:
    """Lengths by a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        pieces = [x.piece for x in spec.pieces if x.type in (1, 4)]  # normal and user-defined ones
        self.pairs = {x[k : k + 2] for x in pieces for k in range(len(x) - 1)}
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.free = plain and not any("\n" in x for x in pieces)
        self.seam = self.free and not any(a != BLANK and b == BLANK for a, b in self.pairs)
        self.memo: dict[str, int] = {}
        self.blank = self._plain(["a "])[0] - self._plain(["a"])[0]  # a last blank by itself
        self.line = self._plain(["\n"])[0] if self.free else 0

    def _plain(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def lengths(self, texts: list[str]) -> list[int]:
        if not self.seam:
            return self._plain(texts)
        units = [_SEAM.split(x) for x in texts]
        memo = self.memo
        new = list({x for u in units for x in u if x not in memo})
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list({x for u in units for x in u})
        memo.update(zip(new, self._plain(new), strict=True))
        memo[""] = self.blank  # a unit is empty behind a last blank only
        return [sum(map(memo.__getitem__, u)) if x else 0 for x, u in zip(texts, units, strict=True)]

    def parts(self, text: str, size: int) -> Iterator[tuple[str, int]]:
        """Parts of about size characters, with the tokens that a part's head adds."""
        if not self.free:
            yield text, 0
            return
        spelt, begin, head, less, at = text.replace(" ", BLANK), 0, "", 0, size
        while at < len(text):
            if at - begin < size or spelt[at - 1 : at + 1] in self.pairs or spelt[at - 1] == spelt[at] == BLANK:
                at += 1
                continue
            yield head + text[begin:at], less
            if text[at] == " " and text[at - 1] != " " and self.seam and at + 1 < len(text):
                begin, head, less = at + 1, "", 0
            else:
                begin, head, less = at, "\n", self.line
            at = begin + size
        yield head + text[begin:], less


class Tokenizers:
    """Lengths by a file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def parts(self, text: str, size: int) -> Iterator[tuple[str, int]]:
        begin = 0
        while cut := _WORD.search(text, begin + size):
            yield text[begin : cut.start() + 1], 0
            begin = cut.start() + 1
        yield text[begin:], 0


_SEAM = re.compile(f"(?<=[^ {BLANK}]) ")
_WORD = re.compile("[A-Za-z](?= [A-Za-z])")


@cache
def opened(path: str) -> SentencePieces | Tokenizers:
    return Tokenizers(path) if path.endswith(".json") else SentencePieces(path)


def batched(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows of about this many bytes together; a larger row is alone."""
    begin, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path)
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for a, b in batched(sizes, BATCH):
                part = batch.slice(a, b - a)
                counts = np.array(model.lengths([x.decode() for x in bytes_of(part.column(4))]), np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts - part.column(3).to_numpy())], names=["_rid", "doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = opened(path)
        for batch in batches:
            for k, text in enumerate(bytes_of(batch.column(4))):
                for number, (part, less) in enumerate(model.parts(text.decode(), PART)):
                    own = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([*own.columns[:2], pa.array([len(part.encode())]), pa.array([less]), pa.array([part]), pa.array([number])], names=["_rid", "doc_id", "size", "less", "text", "part"])

    return run


def counted(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """Per row of docs (_rid, doc_id, text): n_bytes and n_tokens.

    Texts of up to PART bytes are counted where they are read. Parts of longer ones are shuffled by row and place, and a
    row's parts meet again as partial sums only.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("_rid", "doc_id", F.octet_length(text).cast("long").alias("size"), F.lit(0).cast("long").alias("less"), text.alias("text"))
    short = rows.where(F.col("size") <= PART).mapInArrow(_counted(path), "_rid long, doc_id long, n_bytes long, n_tokens long")
    long = rows.where(F.col("size") > PART)
    parts = long.mapInArrow(_cut(path), "_rid long, doc_id long, size long, less long, text string, part long").repartition("_rid", "part")
    pieces = parts.select("_rid", "doc_id", "size", "less", "text").mapInArrow(_counted(path), "_rid long, doc_id long, n_bytes long, n_tokens long")
    sums = pieces.groupBy("_rid").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.union(long.select("_rid", "doc_id", F.col("size").alias("n_bytes")).join(sums, "_rid").select("_rid", "doc_id", "n_bytes", "n_tokens"))
