"""BCF 2: a small decoder of binary records into VCF lines, which then take the way of VCF text.

Files are read in ranges of blocks (``bgzf``); those that are no BGZF by one task each, as a stream.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.exact import g_format
from ..operators.regions import Interval, filter_regions
from .blocked import Memo, dictionaries
from .header import Header
from .vcf import parse_lines, wanted_regions

# Fixed values of the format: magic, and for each type code its size, struct letter, missing and end-of-vector values.
MAGIC = b"BCF\x02"
INTS = {1: (1, "b", -128, -127), 2: (2, "h", -32768, -32767), 3: (4, "i", -(2**31), -(2**31) + 1)}
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = 0x7F800001, 0x7F800002
_MISSING = struct.pack("<I", FLOAT_MISSING)
#: Bytes that are inflated at once where a file is no BGZF.
PIECE = 1 << 20


def inflate(data: bytes) -> Iterator[bytes]:
    """The contents of BGZF blocks, of other concatenated gzip members, or of plain bytes, piece by piece."""
    return inflated(data[at : at + PIECE] for at in range(0, len(data), PIECE))


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of a stream of gzip members, or of plain bytes."""
    d, plain, first = None, False, True
    for data in pieces:
        if first:
            plain, first = data[:2] != b"\x1f\x8b", False
        if plain:
            yield data
            continue
        while data:
            if d is None:
                data = data.lstrip(b"\0")  # padding between members
                d = zlib.decompressobj(31) if data else None
                continue
            yield d.decompress(data)
            data, d = d.unused_data, None if d.eof else d


class Stream:
    """Bytes of pieces, a stretch at a time: what is behind is let go."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        if len(self.held) - self.at < n:
            del self.held[: self.at]
            self.at = 0
            for p in self.pieces:
                self.held += p
                if len(self.held) >= n:
                    break
        out = bytes(self.held[self.at : self.at + n])
        self.at += len(out)
        return out


def _head(buf: bytes, at: int) -> tuple[int, int, int]:
    """(type, length, where the value begins) of a typed value."""
    kind, n = buf[at] & 15, buf[at] >> 4
    at += 1
    if n == 15:
        k, _, at = _head(buf, at)
        size, letter = INTS[k][:2]
        n = struct.unpack_from("<" + letter, buf, at)[0]
        at += size
    return kind, n, at


def _values(buf: bytes, at: int, kind: int, n: int) -> tuple[list, int]:
    """n values as texts ('.' where missing; the list ends at an end-of-vector), and where they end."""
    if kind == 0:
        return [], at
    if kind == CHAR:
        return [buf[at : at + n].rstrip(b"\0").decode("utf-8", "replace")], at + n
    if kind == FLOAT:
        out: list[str] = []
        for bits in struct.unpack_from(f"<{n}I", buf, at):
            if bits == FLOAT_END:
                break
            out.append("." if bits == FLOAT_MISSING else g_format(struct.unpack("<f", struct.pack("<I", bits))[0]))
        return out, at + 4 * n
    size, letter, missing, end = INTS[kind]
    out = []
    for v in struct.unpack_from(f"<{n}{letter}", buf, at):
        if v == end:
            break
        out.append("." if v == missing else str(v))
    return out, at + size * n


def _genotype(buf: bytes, at: int, kind: int, n: int) -> str:
    size, letter, _, end = INTS[kind]
    out = ""
    for i, v in enumerate(struct.unpack_from(f"<{n}{letter}", buf, at)):
        if v == end:
            break
        out += ("" if i == 0 else "|" if v & 1 else "/") + ("." if v >> 1 == 0 else str((v >> 1) - 1))
    return out or "."


def header_text(stream: Stream) -> str:
    """Of a stream at its beginning: no more is inflated than it takes."""
    if stream.take(5)[:4] != MAGIC:
        raise ValueError("not a BCF 2 file")
    return stream.take(struct.unpack("<I", stream.take(4))[0]).rstrip(b"\0").decode()


def header_of(own) -> str:
    """Of records at a file's beginning, which then stand behind it."""
    if not own.need(9) or bytes(own.held[:4]) != MAGIC:
        raise ValueError("not a BCF 2 file")
    n = struct.unpack_from("<I", own.held, 5)[0]
    if not own.need(9 + n):
        raise ValueError("a BCF file ends within its header")
    own.at = 9 + n
    return bytes(own.held[9 : 9 + n]).rstrip(b"\0").decode()


def contigs_of(text: str) -> list[str]:
    """Names by the numbers that records give to contigs; a number without a name is empty."""
    contigs = dictionaries(text.split("\n"))[1]
    return [contigs.get(i, "") for i in range(max(contigs, default=-1) + 1)]


def record_size(buf: bytes, at: int, n_contigs: int, n_samples: int) -> int | None:
    """Bytes of the record whose fixed part may stand there; None where it cannot be one."""
    shared, own, chrom, pos, _, _, counts, samples = struct.unpack_from("<IIiiiIII", buf, at)
    fits = 24 < shared < 1 << 28 and own < 1 << 31 and 0 <= chrom < n_contigs and pos >= -1 and counts >> 16 >= 1 and samples & 0xFFFFFF in (0, n_samples)
    return 8 + shared + own if fits else None


def is_record(buf: bytes, at: int, n_contigs: int, n_samples: int) -> bool:
    """Whether the typed values from there on end where the record says that both of its parts end."""
    shared, own, _, _, _, _, counts, samples = struct.unpack_from("<IIiiiIII", buf, at)
    end, last = at + 8 + shared, at + 8 + shared + own
    size = lambda kind: {0: 0, CHAR: 1, FLOAT: 4}.get(kind) if kind not in INTS else INTS[kind][0]

    def step(at: int, kinds: tuple[int, ...], copies: int = 1) -> int:
        kind, n, at = _head(buf, at)
        if kind not in kinds:
            raise ValueError(kind)
        return at + size(kind) * n * copies

    try:
        at += 32
        for _ in range(1 + (counts >> 16)):
            at = step(at, (CHAR, 0))
        at = step(at, (0, 1, 2, 3))
        for _ in range(counts & 0xFFFF):
            at = step(step(at, (1, 2, 3)), (0, 1, 2, 3, FLOAT, CHAR))
        if at != end:
            return False
        for _ in range(samples >> 24):
            at = step(step(at, (1, 2, 3)), (0, 1, 2, 3, FLOAT, CHAR), samples & 0xFFFFFF)
            if at > last:
                return False
        return at == last
    except (ValueError, IndexError, KeyError, struct.error):
        return False


def lines(data: bytes) -> Iterator[str]:
    """The VCF body lines of a BCF file's bytes, record by record."""
    return lines_of(Stream(inflate(data)))


def lines_of(source: Stream) -> Iterator[str]:
    decode, _, _ = decoder(header_text(source))
    while len(sizes := source.take(8)) == 8:
        n = sum(struct.unpack("<II", sizes))
        record = source.take(n)
        if len(record) < n:
            raise ValueError("a BCF file ends within a record")
        yield decode(sizes + record)


def decoder(text: str) -> tuple[Callable[[bytes], str], int, int]:
    """What makes a VCF line of a record's bytes under a header, and how many contigs and samples that has."""
    header = Header.parse(text.split("\n"))
    names, contigs = dictionaries(text.split("\n"))

    kinds = (*INTS, FLOAT, CHAR)
    sizes = {0: 0, FLOAT: 4, CHAR: 1} | {k: v[0] for k, v in INTS.items()}
    texts = {k: Memo(lambda raw, k=k: ",".join(_values(raw, 0, k, len(raw) // sizes[k])[0]) or ".") for k in kinds} | {0: {b"": "."}}
    calls = {k: Memo(lambda raw, k=k: _genotype(raw, 0, k, len(raw) // sizes[k])) for k in INTS}
    filters = {k: Memo(lambda raw, k=k: ";".join(names[int(x)] for x in _values(raw, 0, k, len(raw) // sizes[k])[0] if x != ".") or ".") for k in kinds} | {0: {b"": "."}}
    quality = Memo(lambda raw: "." if raw == _MISSING else g_format(struct.unpack("<f", raw)[0]))
    flags = {k for k, v in names.items() if v in header.info and header.info[v].type == "Flag"}
    fixed = struct.Struct("<iii4sII")

    def decode(stream: bytes) -> str:
        shared, _ = struct.unpack_from("<II", stream)
        body = 8 + shared
        chrom, pos, _, qual, counts, samples = fixed.unpack_from(stream, 8)
        n_info, n_allele, n_fmt, n_sample = counts & 0xFFFF, counts >> 16, samples >> 24, samples & 0xFFFFFF
        at = 32

        def value(at: int) -> tuple[list, int]:
            kind, n, at = _head(stream, at)
            return _values(stream, at, kind, n)

        def number(at: int) -> tuple[int, int]:
            if stream[at] == 0x11 and stream[at + 1] < 128:  # one small integer, as nearly all are
                return stream[at + 1], at + 2
            key, at = value(at)
            return int(key[0]), at

        name, at = value(at)
        alleles = []
        for _ in range(n_allele):
            first = stream[at]
            if first & 15 == CHAR and first < 0xF0:
                end = at + 1 + (first >> 4)
                alleles.append(stream[at + 1 : end].rstrip(b"\0").decode("utf-8", "replace"))
                at = end
            else:
                a, at = value(at)
                alleles += a or ["."]
        kind, n, at = _head(stream, at)
        end = at + n * sizes[kind]
        flt = filters[kind][stream[at:end]]
        at = end
        info = []
        for _ in range(n_info):
            key, at = number(at)
            kind, n, at = _head(stream, at)
            end = at + n * sizes[kind]
            info.append(names[key] if kind == 0 or key in flags else f"{names[key]}={texts[kind][stream[at:end]]}")
            at = end
        if at > len(stream):
            raise ValueError("a record's values reach beyond it")
        at = body
        keys, columns = [], []
        for _ in range(n_fmt):
            key, at = number(at)
            kind, n, at = _head(stream, at)
            keys.append(names[key])
            wide = n * sizes[kind]
            made = calls[kind] if names[key] == "GT" else texts[kind]
            columns.append([made[stream[p : p + wide]] for p in range(at, at + wide * n_sample, wide)] if wide else [made[b""]] * n_sample)
            at += wide * n_sample
        if at > len(stream):
            raise ValueError("a record's values reach beyond it")
        row = [contigs[chrom], str(pos + 1), (name[0] if name and name[0] else "."), alleles[0] if alleles else ".", ",".join(alleles[1:]) or ".", quality[qual], flt, ";".join(info) or "."]
        if n_fmt and n_sample:
            row += [":".join(keys), *map(":".join, zip(*columns, strict=True))]
        return "\t".join(row)

    return decode, max(contigs, default=-1) + 1, len(header.samples)


def read_bcf(spark: SparkSession, path: str, check_positions: bool = True, regions: Sequence[str | Interval] = (), overlap: str = "start", split: int | None = None) -> tuple[DataFrame, Header]:
    """(variants, header) of BCF files with the same header, read in ranges of ``split`` compressed bytes.

    regions: only rows in any of them; where an index lies beside a file, only its blocks with such rows are inflated.
    """
    from . import bgzf

    files = bgzf.files_of(spark, path)
    if not files:
        raise ValueError(f"no files: {path}")
    f, size = bgzf.open_file(files[0])
    header = Header.parse(header_text(Stream(inflated(f.read_at(PIECE, at) for at in range(0, size, PIECE)))).split("\n"))
    wanted = wanted_regions(regions, header)
    lines = bgzf.load(spark, files, "bcf", split or bgzf.SPLIT, wanted and [(i.contig, i.low, i.high) for i in wanted], overlap)
    rows = parse_lines(lines, header, check_positions)
    return (filter_regions(rows, wanted, overlap=overlap) if wanted else rows), header
