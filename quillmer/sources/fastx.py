"""FASTA/FASTQ as a Python data source: ``spark.read.format("fastx").option("path", "a.fq,b.fa.gz").load()``.

A record begins at ``>`` or ``@``; its whole header line is the name; the sequence goes over lines until ``>``, ``+`` or
``@``; a quality, after ``+``, is as long as the sequence and may go over lines and begin with ``@``. Gzip is told by content. A truncated
quality ends the file.

Files are read in byte ranges of ``split_bytes``. A range owns the records that begin in it: from the first record at or after its start
to the first one at or after the next range's start. In FASTQ of four lines a record, a line is a header if it begins with ``@``, the line two further
on with ``+``, and the lines after each have one length; no other line of such a file fits. In FASTA every ``>`` line is one. Gzip files made of small
blocks that tell their size (BGZF) are cut at blocks. Everything else (one gzip stream, records over several lines of quality) is told by the file's beginning
and read as one range. Each range checks that its last record ends where the next one begins; a file that changes its form further on is an
error that asks for ``split_bytes`` 0, which never splits.

``read_no`` is the place of the record: its byte offset in the (uncompressed) file, for BGZF the block's offset times 65,536 plus the offset in the block;
in a folder of several files these follow each other. So it doesn't depend on how the file is split, and nothing must be counted for it. Paths are
local or shared folders or any URI that pyarrow's file systems know.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schema import READS
from .places import files_of, open_file

SPLIT_BYTES = 64 * 1024 * 1024
#: bytes read at once, text of a batch, and the beginning of a file that tells its form
PIECE, BATCH, HEAD = 1 << 20, 1 << 20, 1 << 16

_ARROW = pa.schema([("sample_id", pa.int32()), ("read_no", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
_NOT_GRAPHIC = bytes(c for c in range(256) if not 33 <= c <= 126)
_HEADS, _NEW = (b">", b"@"), (b">", b"@", b"+")


def parse(lines: Iterator[bytes]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(offset, name, seq, qual) of each record, of any form."""
    at, head, where = 0, None, 0
    while True:
        while head is None:
            line = next(lines, None)
            if line is None:
                return
            if line[:1] in _HEADS:
                head, where = line, at
            at += len(line)
        name, seq, qual, begin = head[1:].rstrip(b"\r\n"), [], [], where
        head, plus = None, False
        for line in lines:
            if line[:1] in _NEW:
                plus = line[:1] == b"+"
                head, where = (None, 0) if plus else (line, at)
                at += len(line)
                break
            at += len(line)
            seq.append(line.translate(None, _NOT_GRAPHIC))
        s, n = b"".join(seq), 0
        if plus:
            while n < len(s):
                line = next(lines, None)
                if line is None:
                    break
                at += len(line)
                qual.append(line.translate(None, _NOT_GRAPHIC))
                n += len(qual[-1])
            if n != len(s):  # truncated
                return
        yield begin, name, s, b"".join(qual)
        if head is None and not plus:
            return


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(name, seq, qual) of each record."""
    for _, *parts in parse(x.encode("latin-1") for x in lines):
        yield tuple(p.decode("latin-1") for p in parts)


# --- texts by place: plain files, blocks, one stream ------------------------------------------------------------------


class Plain:
    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        """(place, text) from a byte of the file on; a character's place is its piece's place and its offset in it."""
        while start < self.size:
            b = self.file.read_at(PIECE, start)
            yield start, b
            start += len(b)


class Blocks(Plain):
    """BGZF: gzip members of at most 64 KiB of text that give their size in an extra field."""

    @staticmethod
    def block_size(b: bytes, at: int = 0) -> int:
        """Size of the compressed block that begins at ``at``; 0 if none does."""
        if b[at : at + 4] != b"\x1f\x8b\x08\x04" or len(b) < at + 18:
            return 0
        extra = struct.unpack_from("<H", b, at + 10)[0]
        k, end = at + 12, at + 12 + extra
        while k + 4 <= min(end, len(b)):
            n = struct.unpack_from("<H", b, k + 2)[0]
            if b[k : k + 2] == b"BC" and n == 2 and k + 6 <= len(b):
                return struct.unpack_from("<H", b, k + 4)[0] + 1
            k += 4 + n
        return 0

    def first_block(self, start: int) -> int:
        """Offset of the first block at or after ``start``: one whose size leads to another block or the file's end."""
        b, k = self.file.read_at(1 << 18, start), -1
        while (k := b.find(b"\x1f\x8b\x08\x04", k + 1)) >= 0:
            n = self.block_size(b, k)
            if n and (start + k + n == self.size or self.block_size(self.file.read_at(64, start + k + n))):
                return start + k
        return self.size

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        at, b, base = self.first_block(start) if start else 0, b"", 0
        while at < self.size:
            if at - base + (1 << 16) > len(b):
                b, base = self.file.read_at(PIECE, at), at
            n = self.block_size(b, at - base)
            if not n:
                raise ValueError(f"no block at byte {at}")
            if text := zlib.decompress(b[at - base : at - base + n], 31):
                yield at << 16, text
            at += n


class Stream(Plain):
    """One gzip file of any number of members; only as a whole."""

    def pieces(self, start: int) -> Iterator[tuple[int, bytes]]:
        d, place = zlib.decompressobj(31), 0
        for _, b in super().pieces(0):
            while b:
                if text := d.decompress(b):
                    yield place, text
                    place += len(text)
                b = d.unused_data
                if d.eof:
                    d = zlib.decompressobj(31)


# --- forms of text ----------------------------------------------------------------------------------------------------


def four_lines(lines: list[str]) -> tuple[list[str], list[str], list[str]] | None:
    """Names, sequences and qualities if the lines are whole records of four."""
    names, seqs, pluses, quals = (lines[k::4] for k in range(4))
    if len(lines) % 4 or not all(x.startswith("@") for x in names) or not all(x.startswith("+") for x in pluses):
        return None
    if lines[0].endswith("\r"):
        seqs, quals, names = ([x.rstrip("\r") for x in v] for v in (seqs, quals, names))
    graphic = lambda v: (j := "".join(v)).isascii() and j.isprintable() and " " not in j
    if list(map(len, seqs)) != list(map(len, quals)) or not graphic(seqs) or not graphic(quals) or any(x[:1] in (">", "@", "+") for x in seqs):
        return None
    return [x[1:] for x in names], seqs, quals


def first_header(text: bytes, fasta: bool, begins_line: bool) -> int:
    """Offset of the first record's header; -1 if the text is too short to tell."""
    if fasta:
        return 0 if begins_line and text[:1] == b">" else text.find(b"\n>") + 1 or -1
    at = 0 if begins_line else text.find(b"\n") + 1 or len(text)
    lines = text[at:].split(b"\n")
    for k in range(len(lines) - 4):  # the last line may be cut
        a, s, p, q = (x.rstrip(b"\r") for x in lines[k : k + 4])
        if a[:1] == b"@" and p[:1] == b"+" and len(s) == len(q):
            return at
        at += len(lines[k]) + 1
    return -1


@dataclass
class Range(InputPartition):
    """Compressed bytes of a file; ``base`` is added to the places of its records. ``exact``: a record begins at both ends."""

    sample_id: int
    path: str
    base: int
    kind: str
    fasta: bool
    start: int
    end: int | None
    exact: bool = False

    def open(self) -> Plain:
        return {"plain": Plain, "blocks": Blocks, "stream": Stream}[self.kind](open_file(self.path))


def form_of(path: str) -> tuple[str, bool | None, int]:
    """Kind of file, whether it is FASTA (None: of a form that can't be split), and its size."""
    file = open_file(path)
    head = file.read_at(HEAD, 0)
    kind = "plain" if head[:2] != b"\x1f\x8b" else "blocks" if Blocks.block_size(head) else "stream"
    text = head if kind == "plain" else b"" if kind == "stream" else next(Blocks(file).pieces(0), (0, b""))[1]
    if text[:1] == b">":
        return kind, None if b"\n+" in text or b"\n@" in text else True, file.size()
    lines = text.decode("latin-1").split("\n")
    whole = lines[: (len(lines) - 1) // 4 * 4]
    return kind, False if whole and four_lines(whole) else None, file.size()


def ranges(paths: list[str], split_bytes: int = SPLIT_BYTES) -> list[Range]:
    out = []
    for sample, path in enumerate(paths):
        base = 0
        for file in files_of(path):
            kind, fasta, size = form_of(file)
            step = split_bytes if split_bytes and fasta is not None and kind != "stream" else size
            starts = list(range(0, size, max(1, step)))
            whole = fasta is None or kind == "stream" or len(starts) < 2
            out += [Range(sample, file, base, kind, bool(fasta), a, None if whole or a + step >= size else a + step) for a in starts[: 1 if whole else None]]
            base += size << 16
    return out


# --- reading a range --------------------------------------------------------------------------------------------------


def first_place(source: Plain, start: int, fasta: bool) -> int | None:
    """Place of the first record at or after a byte of the file; None if no record begins there."""
    text, pieces, marks = b"", source.pieces(max(0, start - 1) if type(source) is Plain else start), []
    for place, piece in pieces:
        if not marks and type(source) is Plain:  # the byte before tells whether a line begins here
            marks.append((0, place))
        elif type(source) is not Plain:
            marks.append((len(text), place))
        text += piece
        at = first_header(text, fasta, False)
        if at >= 0:
            off, at_place = max(m for m in marks if m[0] <= at)
            return at_place + at - off
    return None


def _batch(r: Range, places: list | np.ndarray, names: list, seqs: list, quals: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), r.sample_id, np.int32)), pa.array(r.base + np.asarray(places, np.int64)), pa.array(names, pa.string()), pa.array(seqs, pa.string()), pa.array(quals, pa.string())], schema=_ARROW)


def _whole(r: Range, source: Plain) -> Iterator[pa.RecordBatch]:
    """A file of any form, record by record."""

    def lines() -> Iterator[bytes]:
        rest = b""
        for _, piece in source.pieces(0):
            *done, rest = (rest + piece).split(b"\n")
            for x in done:
                yield x + b"\n"
        if rest:
            yield rest

    def places(at: list[int]) -> list[int]:
        if not isinstance(source, Blocks):
            return at
        while len(starts) < 2 or starts[-1][0] <= at[-1]:  # blocks as far as the records go
            text = next(blocks, None)
            if text is None:
                break
            starts.append((starts[-1][0] + starts[-1][2] if starts else 0, text[0], len(text[1])))
        begin = np.array([s[0] for s in starts])
        k = np.searchsorted(begin, at, "right") - 1
        return [starts[i][1] + a - starts[i][0] for i, a in zip(k.tolist(), at)]

    starts: list[tuple[int, int, int]] = []
    blocks = source.pieces(0)
    held, size = [], 0
    for x in parse(lines()):
        held.append(x)
        size += sum(map(len, x[1:]))
        if size >= BATCH:
            yield _batch(r, places([h[0] for h in held]), *([h[k].decode("latin-1") for h in held] for k in (1, 2, 3)))
            held, size = [], 0
    if held:
        yield _batch(r, places([h[0] for h in held]), *([h[k].decode("latin-1") for h in held] for k in (1, 2, 3)))


def read_range(r: Range) -> Iterator[pa.RecordBatch]:
    """The records that begin in a range."""
    source = r.open()
    if r.start == 0 and r.end is None:
        yield from _whole(r, source)
        return
    start = r.start if r.start == 0 or r.exact else first_place(source, r.start, r.fasta)
    stop = r.end if r.end is None or r.exact else first_place(source, r.end, r.fasta)
    if start is None or start == stop:
        return
    text, marks, ended = bytearray(), [], False

    def take(last: bool) -> Iterator[pa.RecordBatch]:
        """Batches of the whole records in ``text``, which go; of all that is there if it is the last of the file."""
        nonlocal text, marks
        where, place = (np.array(x, np.int64) for x in zip(*marks))
        at = lambda offsets: place[(k := np.searchsorted(where, offsets, "right") - 1)] + offsets - where[k]
        if r.fasta:
            cut = len(text) if ended else text.rfind(b"\n>") + 1
            whole = bytes(text[:cut])
            if b"\n+" in whole or b"\n@" in whole:
                raise ValueError(f"{r.path} has records of more than one form; read it with split_bytes=0")
            found = list(parse(iter(whole.splitlines(keepends=True)))) if cut else []
            if found:
                yield _batch(r, at(np.array([f[0] for f in found])), *([f[k].decode("latin-1") for f in found] for k in (1, 2, 3)))
        else:
            lines = text.decode("latin-1").split("\n")
            n = (len(lines) - 1) // 4 * 4
            whole = lines[:n]
            cut = sum(map(len, whole)) + n
            parts = four_lines(whole) if n else ([], [], [])
            if parts is None:
                raise ValueError(f"{r.path} isn't of four lines a record throughout; read it with split_bytes=0")
            if n:
                size = np.fromiter(map(len, whole), np.int64) + 1
                yield _batch(r, at((np.cumsum(size) - size)[::4]), *parts)
            if last and cut < len(text):  # a last record without a line end, or a truncated one
                rest = list(parse(iter(bytes(text[cut:]).splitlines(keepends=True))))
                if rest:
                    yield _batch(r, at(np.array([f[0] + cut for f in rest])), *([f[k].decode("latin-1") for f in rest] for k in (1, 2, 3)))
                cut = len(text)
        if ended and not last and cut < len(text):
            raise ValueError(f"{r.path} has a record over the start of the next range that isn't of its form; read it with split_bytes=0")
        kept = max(0, int(np.searchsorted(where, cut, "right")) - 1)
        marks = [(max(0, w - cut), p + max(0, cut - w)) for w, p in marks[kept:]]
        text = text[cut:]

    for place, piece in source.pieces(start if type(source) is Plain else start >> 16):
        if place < start:  # the block that the first record begins in
            place, piece = start, piece[start - place :]
        if stop is not None and place + len(piece) >= stop and (type(source) is Plain or place >> 16 >= stop >> 16):
            piece, ended = piece[: max(0, stop - place)], True
        marks.append((len(text), place))
        text += piece
        if ended:
            break
        if len(text) >= BATCH:
            yield from take(False)
    ended = True
    if text:
        yield from take(stop is None)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], split_bytes: int):
        self.paths, self.split_bytes = paths, split_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.paths, self.split_bytes) or [Range(0, "", 0, "", False, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter(())


def complete(path: str) -> int:
    """Bytes of a plain file of four lines a record up to the end of its last whole record."""
    file = open_file(path)
    size, back = file.size(), HEAD
    while size:
        at = max(0, size - back)
        begin = 0 if at == 0 else first_place(Plain(file), at, False)
        if begin is not None:
            lines = file.read_at(size - begin, begin).split(b"\n")
            whole = lines[: (len(lines) - 1) // 4 * 4]
            if whole and four_lines([x.decode("latin-1") for x in whole]) is None:
                raise ValueError(f"{path} isn't of four lines a record")
            return begin + sum(map(len, whole)) + len(whole)
        if at == 0:
            break
        back *= 4
    return 0


class _Stream(DataSourceStreamReader):
    """Whole records of the files of a folder as files come and grow; the offset is the bytes read of each file."""

    def __init__(self, path: str, sample_id: int, split_bytes: int):
        self.path, self.sample_id, self.split_bytes = path, sample_id, split_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {f: n for f in files_of(self.path) if (n := complete(f))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in end.items():
            begin = start.get(path, 0)
            # inner cuts are anywhere, as in a batch; the outer ones are where records begin and end
            cuts = [begin, *range(begin + self.split_bytes, stop, self.split_bytes), stop] if self.split_bytes else [begin, stop]
            at = [begin, *(first_place(Plain(open_file(path)), c, False) or stop for c in cuts[1:-1]), stop]
            out += [Range(self.sample_id, path, 0, "plain", False, a, b, True) for a, b in zip(at, at[1:]) if a < b]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        for batch in read_range(partition):
            yield from (tuple(x.values()) for x in batch.to_pylist())

    def commit(self, end: dict) -> None:
        pass


class FastxSource(DataSource):
    """Options: path (files or folders, one a sample, by commas), split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self):
        return READS

    def reader(self, schema) -> _Reader:
        return _Reader([p for p in self.options.get("path", "").split(",") if p], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def streamReader(self, schema) -> _Stream:  # noqa: N802
        return _Stream(self.options["path"], int(self.options.get("sample_id", 0)), int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_fastx(spark, paths: list[str], split_bytes: int = SPLIT_BYTES):
    """Reads of all files; the sample id is the place in the list of the file, or of the folder it is in."""
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("path", ",".join(paths)).option("split_bytes", str(split_bytes)).load()


def stream_fastx(spark, path: str, *, sample_id: int = 0, split_bytes: int = SPLIT_BYTES):
    """Reads of a folder's FASTQ files (plain, four lines a record) as they come and grow; a record is read once it is whole.
    ``read_no`` is the record's place in its own file."""
    spark.dataSource.register(FastxSource)
    return spark.readStream.format("fastx").option("path", path).option("sample_id", str(sample_id)).option("split_bytes", str(split_bytes)).load()
