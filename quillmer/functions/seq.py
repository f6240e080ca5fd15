"""Sequence functions: k-mers as strings or as 2-bit packed longs (A 0, C 1, G 2, T 3, first base highest, k <= 31).

Packed order is lexicographic order, so the canonical form is the smaller of a k-mer and its reverse complement in both
views. Column functions give null for null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import COUNTS

BASES = "ACGT"
#: code of each byte; 4: not a base
_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
_CODE_LOWER = _CODE.copy()
for _i, _c in enumerate(b"acgt"):
    _CODE_LOWER[_c] = _i


def clean(seq: Column, invalid: str = "as_a") -> Column:
    """``as_a``: what isn't A, C, G or T reads as A; ``skip``: lower case counts, the rest becomes N."""
    return F.regexp_replace(seq, "[^ACGT]", "A") if invalid == "as_a" else F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def encode(kmer: Column) -> Column:
    """Packed long of a string of bases; other characters count as A."""
    return F.conv(F.translate(clean(kmer), "ACGT", "0123"), 4, 10).cast("long")


def decode(packed: Column, k: int) -> Column:
    """String of a packed k-mer, four bases at a time from a table."""
    pieces = []
    for at in range(0, k, 4):
        n = min(4, k - at)
        table = F.array(*[F.lit("".join(x)) for x in product(BASES, repeat=n)])
        pieces.append(F.get(table, F.shiftright(packed, 2 * (k - at - n)).bitwiseAND(F.lit(4**n - 1)).cast("int")))
    return F.concat(*pieces)


def roll_forward(packed: Column, base: Column, k: int) -> Column:
    """Drop the first base, append ``base`` (0-3)."""
    return F.shiftleft(packed, 2).bitwiseAND(F.lit((1 << 2 * k) - 1)).bitwiseOR(base.cast("long"))


def roll_backward(packed: Column, base: Column, k: int) -> Column:
    """Drop the last base, put ``base`` (0-3) in front."""
    return F.shiftright(packed, 2).bitwiseOR(F.shiftleft(base.cast("long"), 2 * (k - 1)))


def links(packed: Column, k: int) -> Column:
    """The eight neighbours: 0-3 forward by A, C, G, T, 4-7 backward."""
    return F.array(*[roll_forward(packed, F.lit(b), k) for b in range(4)], *[roll_backward(packed, F.lit(b), k) for b in range(4)])


def base_at(packed: Column, i: int, k: int) -> Column:
    return F.shiftright(packed, 2 * (k - 1 - i)).bitwiseAND(F.lit(3))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a short sequence in order, as strings. Taking each from the start is quadratic in the length: reads go
    through ``pack_windows``."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


#: bases that kernels take at once: their arrays take about 60 bytes for each
GROUP_BASES = 1 << 20
#: between sequences: no byte of UTF-8 text
_SEP = 255


def groups(*columns: list, bases: int = GROUP_BASES) -> Iterator[tuple]:
    """Cut parallel lists, sequences last, into groups of about ``bases``; null and empty sequences go."""
    held, size = [], 0
    for row in zip(*columns):
        if row[-1]:
            held.append(row)
            size += len(row[-1])
            if size >= bases:
                yield tuple(map(list, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(list, zip(*held)))


def joined(seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all sequences, a separator after each; where each begins; how long each is."""
    parts = [s.encode() for s in seqs]
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"\xff".join(parts), np.uint8), np.cumsum(n + 1) - n - 1, n


def _width(k: int) -> type:
    """The narrower of the types that hold a packed k-mer."""
    return np.int32 if k <= 15 else np.int64


def _rolled(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed forms of all windows of ``k`` codes, forward and as reverse complements, by doubling their length."""

    def both(x, nx: int, y, ny: int):
        n = len(c) - nx - ny + 1
        return x[0][:n] << 2 * ny | y[0][nx : nx + n], y[1][nx : nx + n] << 2 * nx | x[1][:n]

    out, size, p, step = None, 0, (c, 3 - c), 1
    while True:
        if k & step:
            out, size = (both(out, size, p, step), size + step) if out else (p, step)
        if size == k:
            return out
        p, step = both(p, step, p, step), 2 * step


def pack_windows(seq: bytes | np.ndarray, k: int, invalid: str = "skip", both_strands: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Packed k-mers of all windows and whether each is valid; for ``as_a`` all are but those over a separator."""
    raw = np.frombuffer(seq, np.uint8) if isinstance(seq, bytes) else seq
    if len(raw) < k:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    code = _CODE[raw] if invalid == "as_a" else _CODE_LOWER[raw]
    bad = raw == _SEP if invalid == "as_a" else code == 4
    fwd, rc = _rolled((code & 3).astype(_width(k)), k)
    total = np.concatenate([[0], np.cumsum(bad, dtype=np.int32)])
    return (np.minimum(fwd, rc) if both_strands else fwd).astype(np.int64), total[k:] == total[:-k]


def windows_of(starts: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows that lie in one sequence: their place, the sequence's number and the position in it."""
    n = np.maximum(lengths - k + 1, 0)
    which = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[which] + pos, which, pos


def count_in_batches(reads: DataFrame, k: int, *, invalid: str = "skip", both_strands: bool = True) -> DataFrame:
    """(sample_id, kmer, cnt) partial counts: one combined row per k-mer, sample and batch, before any shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_sample: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for samples, seqs in groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                order = np.argsort(samples, kind="stable")
                bounds = np.flatnonzero(np.diff(np.array(samples)[order], prepend=-(1 << 40)))
                for x, y in zip(bounds, np.append(bounds[1:], len(order))):
                    kmer, ok = pack_windows(joined([seqs[i] for i in order[x:y]])[0], k, invalid, both_strands)
                    by_sample.setdefault(samples[order[x]], []).append(np.unique(kmer[ok], return_counts=True))
            for sample, parts in by_sample.items():
                kmer, cnt = parts[0] if len(parts) == 1 else added(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kmer), sample, np.int32)), pa.array(kmer), pa.array(cnt.astype(np.int64))], names=COUNTS.names)

    return reads.select("sample_id", "seq").where("sample_id is not null").mapInArrow(count, COUNTS)


def added(kmer: np.ndarray, cnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-mers and their summed counts."""
    distinct, at = np.unique(kmer, return_inverse=True)
    return distinct, np.bincount(at, cnt, len(distinct)).astype(np.int64)


def signature(m: int, kmer: Column) -> Column:
    """Smallest normalised m-mer of a k-mer: the smaller of an m-mer and its reverse complement, of those that are allowed.

    Not allowed, to avoid poor bins: m-mers that end in TGT or in TT and a base, that begin with ACA, or that have AA after
    their first base. A k-mer without an allowed m-mer has the special value 4^m.
    """
    special = F.lit(1 << 2 * m).cast("long")

    def value(x: Column) -> Column:
        poor = x.endswith("TGT") | x.rlike("TT.$") | x.startswith("ACA") | F.substring(x, 2, m).contains("AA")
        return F.when(poor, special).otherwise(encode(x))

    return F.array_min(F.transform(kmers(kmer, m), lambda x: F.least(value(x), value(revcomp(x)))))


def signature_table(m: int) -> np.ndarray:
    """Normalised value of each packed m-mer, by the rule of ``signature``."""
    x = np.arange(4**m, dtype=np.int64)
    base = lambda v, i: (v >> 2 * (m - 1 - i)) & 3
    rev = np.zeros_like(x)
    for i in range(m):
        rev |= (3 - base(x, i)) << 2 * i

    def value(v: np.ndarray) -> np.ndarray:
        last, mid, third = base(v, m - 1), base(v, m - 2), base(v, m - 3)
        poor = (third == 3) & ((mid == 3) | (mid == 2) & (last == 3)) | (base(v, 0) == 0) & (base(v, 1) == 1) & (base(v, 2) == 0)
        for i in range(1, m - 1):
            poor |= (base(v, i) == 0) & (base(v, i + 1) == 0)
        return np.where(poor, 4**m, v)

    return np.minimum(value(x), value(rev))


def _lowest(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by doubling."""
    step = 1
    while 2 * step <= w:
        x, step = np.minimum(x[:-step], x[step:]), 2 * step
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def signature_runs(seq: bytes | np.ndarray, k: int, m: int, table: np.ndarray, invalid: str = "skip") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, signature) of the runs of neighbouring valid k-mers with one signature; sequences may be joined."""
    part, fine = pack_windows(seq, m, invalid, both_strands=False)
    _, ok = pack_windows(seq, k, invalid)
    if not len(ok):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _lowest(np.where(fine, table[part], 4**m), k - m + 1)
    starts = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])))
    n = np.diff(starts, append=len(ok))
    return starts[ok[starts]], n[ok[starts]], low[starts[ok[starts]]]


def two_bits(raw: np.ndarray, start: np.ndarray, length: np.ndarray, first: np.ndarray, end: np.ndarray, invalid: str = "skip") -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``raw`` from ``start`` on, two bits a base, those from ``first[g]`` to ``end[g]`` together in whole bytes; and each group's bytes."""
    total = np.add.reduceat(length, first)
    padding = -total % 4
    extra = np.zeros(len(start), np.int64)
    extra[end - 1] = padding
    n = length + extra
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    code = (_CODE if invalid == "as_a" else _CODE_LOWER)[raw[np.minimum(at, len(raw) - 1)]] & 3  # what pads is never read
    return code.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8), (total + padding) // 4


#: k-mers whose bases are spread at once, about 150 bytes for each
EXPAND = 250_000


def kmers_of_rows(n: np.ndarray, n_runs: np.ndarray, runs: np.ndarray, n_bytes: np.ndarray, bases: np.ndarray, k: int) -> np.ndarray:
    """Packed canonical k-mers of rows of super-k-mers: how many k-mers, super-k-mers and bytes of bases each row has, the k-mers of each
    super-k-mer, and the bases, two bits each, a row's in whole bytes."""
    at, at_run, at_byte = (np.append(0, np.cumsum(x)) for x in (n, n_runs, n_bytes))
    out, x = np.empty(at[-1], np.int64), 0
    while x < len(n):
        y = max(x + 1, int(np.searchsorted(at, at[x] + EXPAND, "right")) - 1)
        own = runs[at_run[x] : at_run[y]].astype(np.int64)
        length = own + k - 1
        begin = np.cumsum(length) - length
        first = at_run[x:y] - at_run[x]  # where each row's runs begin: each row has one
        begin += np.repeat(4 * (at_byte[x:y] - at_byte[x]) - begin[first], n_runs[x:y])
        code = (bases[at_byte[x] : at_byte[y], None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(_width(k))
        fwd, rc = _rolled(code, k)
        place = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
        out[at[x] : at[y]] = np.minimum(fwd[place], rc[place])
        x = y
    return out
