"""SentencePiece encoding and decoding by a distinct-chunk table.

The normalised text is a run of marked words: one or more markers (U+2581, what a space becomes)
and then characters that are none.  Where no piece has a marker after another character, no merge
crosses the start of a marked word, so each can be segmented by itself.  A worker keeps a table of
the distinct marked words met so far, segments each once with the library and joins the ids back by
position.  The table is emptied when it reaches ``TABLE_ENTRIES`` and holds no word over
``TABLE_CHARS``, so its memory is bounded; both only cost a word a second segmentation.  A model
whose pieces can cross markers, or that normalises text, is applied to whole texts instead.

Defined cases: a null text counts as empty; an empty text has only the begin and end ids and decodes
to the empty text; a U+2581 in a text decodes to a space, as in the library; columns besides those
asked for are not carried, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices

MARK = "▁"
TABLE_ENTRIES = 400_000
TABLE_CHARS = 48
_MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


def load(model: bytes):
    """The library's processor for a serialised model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_marks(model: bytes) -> bool:
    """Whether marked words can be segmented apart: text kept as it is, one marker put in front, no piece
    with a marker after another character, no piece taken from the text before segmenting."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    form, user_defined = proto.normalizer_spec, pb.ModelProto.SentencePiece.USER_DEFINED
    return (
        not form.precompiled_charsmap
        and form.add_dummy_prefix
        and form.escape_whitespaces
        and not form.remove_extra_whitespaces
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and proto.trainer_spec.byte_fallback
        and proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        and not any(p.type == user_defined or MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        and any(p.piece == MARK for p in proto.pieces)
    )


class _Table(dict):
    """Marked word -> packed ids; ``texts`` has the decoded text of the same words."""

    def __init__(self, processor) -> None:
        super().__init__()
        self.processor = processor
        self.lone = processor.piece_to_id(MARK)
        self.texts = _Texts(self)

    def ids(self, word: str) -> list[int]:
        # the library puts a marker in front itself, but not before an empty text
        return self.processor.encode(word[1:]) if len(word) > 1 else [self.lone]

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.ids(word), dtype="<u4").tobytes()
        if len(word) <= TABLE_CHARS:
            if len(self) >= TABLE_ENTRIES:
                self.clear()
                self.texts.clear()
            self[word] = packed
        return packed


class _Texts(dict):
    def __init__(self, table: _Table) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: str) -> str:
        ids = np.frombuffer(self.table[word], dtype="<u4").tolist()
        text = " " + self.table.processor.decode(ids)  # decode() takes one leading marker away
        if len(word) <= TABLE_CHARS:
            self[word] = text
        return text


class RoundTrip:
    """Encodes texts and decodes the ids again, with one table for all texts of a worker."""

    def __init__(self, model: bytes, apart: bool) -> None:
        self.processor = load(model)
        self.table = _Table(self.processor)
        self.apart = apart
        self.begin, self.end = (np.array([i], dtype="<u4").tobytes() for i in (self.processor.bos_id(), self.processor.eos_id()))

    def __call__(self, text: str | None) -> tuple[bytes, str]:
        """The ids with begin and end, as little-endian unsigned 32-bit integers, and what they decode to."""
        if not text:
            return self.begin + self.end, ""
        if self.apart:
            words = _MARKED_WORD.findall(MARK + text.replace(" ", MARK))
            packed, decoded = b"".join(map(self.table.__getitem__, words)), "".join(map(self.table.texts.__getitem__, words))[1:]
        else:
            ids = self.processor.encode(text)
            packed, decoded = np.array(ids, dtype="<u4").tobytes(), self.processor.decode(ids)
        return self.begin + packed + self.end, decoded

    def count(self, text: str | None) -> int:
        """How many ids a text has, without begin and end."""
        if not text:
            return 0
        if not self.apart:
            return len(self.processor.encode(text))
        return sum(map(len, map(self.table.__getitem__, _MARKED_WORD.findall(MARK + text.replace(" ", MARK))))) // 4


def encode(documents: DataFrame, model_path: str, text: str = "text", carry: Sequence[str] = ("doc_id",), packed: bool = False) -> DataFrame:
    """The ``carry`` columns, ``n_tokens``, ``ids`` (array<int>, or packed binary) and ``decoded`` for every row."""
    with open(model_path, "rb") as file:
        model = file.read()
    apart = splits_at_marks(model)
    kept = [documents.schema[c] for c in carry]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    n, names = len(kept), [f.name for f in (*kept, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        round_trip = RoundTrip(model, apart)
        for batch in slices(batches, "_text"):
            rows = [round_trip(x) for x in batch.column(n).to_pylist()]
            ids = [r[0] for r in rows]
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            if packed:
                column = pa.array(ids, pa.binary())
            else:
                ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts), column, pa.array([r[1] for r in rows], pa.string())], names=names)

    chosen = documents.select(*carry, F.col(text).alias("_text"))
    return chosen.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), *added]))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns and ``decoded``, the text of an array<int> column; null ids decode to the empty text."""
    with open(model_path, "rb") as file:
        model = file.read()
    kept = [encoded.schema[c] for c in carry]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField("decoded", T.StringType())])
    n, names = len(kept), [*(f.name for f in kept), "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        for batch in batches:
            texts = [processor.decode(x) if x else "" for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], names=names)

    return encoded.select(*carry, F.col(ids).alias("_ids")).mapInArrow(run, schema)
