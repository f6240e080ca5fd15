"""SentencePiece encoding and decoding of merge-type (BPE) models by a table of prefixes.

For every prefix of a text one token is the last of the prefix's encoding. It is found among the tokens that end there (matches
of an automaton over all pieces, longest first): the first one that is compatible with the last token of the prefix before it. Two tokens are
compatible if merging the characters of both gives just these two. The ids are then read from the table backwards. The time is
linear in the text, where merging pairs by a queue isn't.

Texts are normalised by the model, then cut where no piece of the model goes over the cut: before a space mark that follows another
character, and around line ends. What lies between two cuts is encoded once in a worker and remembered.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; characters without a piece give their
bytes' pieces, or the unknown id in a model without them; marks of control pieces in a text are ordinary text; every row gets a row, in
any order; an empty table gives an empty table; all other columns are kept untouched, whatever their names.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, col

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: stretches that a worker remembers, up to LONG characters each (about 200 bytes on average), and pairs of tokens
MEMORY_STRETCHES, LONG, MEMORY_PAIRS = 500_000, 64, 1_000_000


class PieceCoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        self.piece = {i: m.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.rank = {self.piece[i]: -m.get_score(i) for i in normal}
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.piece.items():
            if self.merge(piece) == [i]:  # a piece that merging never reaches is never used
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = m.unk_id()
        self.has_bytes = all(m.is_byte(i) for i in self.bytes)
        over = any(re.search(f"[^{SPACE}]{SPACE}|.\n|\n.", p) for p in self.piece.values())
        self.stretches = re.compile(".+" if over else f"\n+|{SPACE}*[^{SPACE}\n]+|{SPACE}+", re.DOTALL).findall
        self.pairs: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}

    def merge(self, text: str, cut: int = 0) -> list[int] | None:
        """Ids after merging the characters of a short text, best pair first, the leftmost of equals; -1 for an unknown character.
        None as soon as a merge goes over the ``cut``-th character's start."""
        parts, rank, none = list(text), self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            if at == cut - 1:
                return None
            cut -= at < cut
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
        return [self.id.get(p, -1) for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= MEMORY_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.merge(self.piece[a] + self.piece[b], len(self.piece[a])) is not None
        return known

    def ids_of(self, text: str) -> list[int]:
        """Ids of a normalised text."""
        last = [-1] * (len(text) + 1)  # the last token of each prefix; -1: an unknown character, which no merge goes over
        known = self.pairs.get
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] < 0:
                before = last[end - n]
                if before < 0:
                    last[end] = token
                else:
                    fit = known(before << 32 | token)
                    if fit or fit is None and self.compatible(before, token):
                        last[end] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            if token >= 0:
                out.append(token)
                at -= len(self.piece[token])
            else:
                at -= 1
                out += [self.bytes[b] for b in reversed(text[at].encode())] if self.has_bytes else [self.unknown]
        return out[::-1] if self.has_bytes else self._joined(out[::-1])

    def _joined(self, ids: list[int]) -> list[int]:
        """A run of unknown characters is one unknown token."""
        return [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers."""
        parts, memory = self.stretches(self.model.normalize(text)), self.memory
        if not self.has_bytes:  # unknown runs may go over cuts
            return np.array(self._joined([x for p in parts for x in self.ids_of(p)]), "<i4").tobytes()
        out = list(map(memory.get, parts))
        if None in out:
            for k, p in enumerate(parts):
                if out[k] is None:
                    out[k] = memory.get(p) or np.array(self.ids_of(p), "<i4").tobytes()
                    if len(p) <= LONG:
                        if len(memory) >= MEMORY_STRETCHES:
                            memory.clear()
                        memory[p] = out[k]
        return b"".join(out)


_coders: dict[str, PieceCoder] = {}


def coder(model: str = MODEL) -> PieceCoder:
    if model not in _coders:
        import public_tokenizers

        _coders[model] = PieceCoder(model if os.sep in model else public_tokenizers.path(model))
    return _coders[model]


def _with(docs: DataFrame, source: str, out: str, kind: T.DataType, make) -> DataFrame:
    """``docs`` with a column ``out``, in the place of one of that name, that ``make`` gives for the Arrow array of ``source``."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    # plain names meanwhile: those of the table may hold dots
    rows = docs.select(*[col(c).alias(f"c{k}") for k, c in enumerate(kept)], col(source).alias("given"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("made", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], make(batch.columns[-1])], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept, out)


def encode(docs: DataFrame, *, text_col: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the ids of each whole text."""

    def ids(texts: pa.Array) -> pa.Array:
        c = coder(model)
        raw = [c.encode(t) if t else b"" for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in raw])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), "<i4")))

    return _with(docs, text_col, out, T.ArrayType(T.IntegerType()), ids)


def decode(tokens: DataFrame, *, ids_col: str = "ids", out: str = "text", model: str = MODEL) -> DataFrame:
    """``tokens`` with the text of each list of ids, as the model's library decodes it; null ids read as an empty list."""

    def texts(ids: pa.Array) -> pa.Array:
        m = coder(model).model
        flat, at = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        valid = ids.is_valid().to_pylist()
        return pa.array([m.decode(flat[a:b].tolist()) if ok and b > a else "" for a, b, ok in zip(at, at[1:], valid)], pa.string())

    return _with(tokens, ids_col, out, T.StringType(), texts)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    ids = encode(docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")), out="ids", model=model).select("doc_id", "ids")
    listed = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    said = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
    return decode(said, model=model).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
