"""Blocked gzip (BGZF) and BCF 2 as output: each task writes the rows of its partition to a file of its own.

Files get their final names when all tasks have ended, so that a task that is tried again leaves nothing behind. Paths
must be ones that executors can open through pyarrow (a mounted folder, or a URI that it knows).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from . import csi
from .header import Header

# Fixed values of the formats: an empty last block, the most bytes of a block, type codes, and values for what is missing.
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 65280
INTS = ((1, "b", -(2**7), -120, 127), (2, "h", -(2**15), -32760, 32767), (3, "i", -(2**31), -(2**31) + 8, 2**31 - 1))
FLOAT, CHAR = 5, 7
FLOAT_MISSING, FLOAT_END = struct.pack("<I", 0x7F800001), struct.pack("<I", 0x7F800002)
_END = re.compile(r"(?:^|;)END=(\d+)(?:;|$)")


def pack(raw: bytes, level: int = 6) -> bytes:
    """One BGZF block."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(raw) + c.flush()
    if len(body) + 26 > 65536:  # does not shrink: stored as it is
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush()
    return bytes.fromhex("1f8b08040000000000ff060042430200") + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def blocks(pieces: Iterable[bytes], level: int = 6, size: int = BLOCK) -> Iterator[bytes]:
    """The BGZF blocks of a stream, each of size bytes but for the last, without the last empty one."""
    held = bytearray()
    for p in pieces:
        held += p
        at = 0
        while len(held) - at >= size:
            yield pack(bytes(held[at : at + size]), level)
            at += size
        del held[:at]
    if held:
        yield pack(bytes(held), level)


#: Where a record is: contig, its first base counted from 0, the base behind its last.
Place = tuple[str, int, int]


def write_blocked(out: BinaryIO, pieces: Iterable[tuple[bytes, Place | None]], depth: int | None, contigs: list[str] | None = None, size: int = BLOCK) -> bytes | None:
    """Write a BGZF file of pieces and return the contents of its index of so many levels, if any. Records are pieces with a place."""
    index, done, offsets, at = None if depth is None else csi.Builder(depth), 0, [], 0

    def placed() -> Iterator[bytes]:
        nonlocal done
        for raw, place in pieces:
            if index is not None and place is not None:
                index.add(*place, done, done + len(raw))
            done += len(raw)
            yield raw

    for block in blocks(placed(), size=size):
        offsets.append(at)
        out.write(block)
        at += len(block)
    offsets.append(at)  # where the last, empty block begins
    out.write(END)
    return None if index is None else index.pack(offsets, size, contigs)


def write_parts(rows: DataFrame, path: str, suffix: str, encode: Callable[[Iterator[str]], Iterator[tuple[bytes, Place | None]]], depth: int | None = None, contigs: list[str] | None = None) -> None:
    """The partitions of one text column, in order, as files part-00000<suffix> ... under path, which must be new, each with
    an index of ``depth`` levels beside it, if that is given. contigs: those that the files number themselves."""
    from pyarrow import fs

    ship(rows.sparkSession)
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise ValueError(f"output exists: {path}")
    store.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = fs.FileSystem.from_uri(path)[0] if "://" in path or path.startswith("file:") else fs.LocalFileSystem()
        name = f"_part-{uuid.uuid4().hex}"
        with own.open_output_stream(f"{root}/{name}") as out:
            index = write_blocked(out, encode(v for b in batches for v in b.column(0).to_pylist()), depth, contigs)
        if index is not None:
            with own.open_output_stream(f"{root}/{name}.csi") as out:
                for block in [*blocks([index]), END]:
                    out.write(block)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name])], ["n", "name"])

    done = {r.n: r["name"] for r in rows.mapInArrow(run, "n bigint, name string").collect()}  # a name for each task
    for i, n in enumerate(sorted(done)):
        if depth is not None:
            store.move(f"{root}/{done[n]}.csi", f"{root}/part-{i:05d}{suffix}.csi")
        store.move(f"{root}/{done[n]}", f"{root}/part-{i:05d}{suffix}")
    for left in store.get_file_info(fs.FileSelector(root)):
        if left.base_name.startswith("_part-"):
            store.delete_file(left.path)


def place_of(line: str) -> Place:
    """Of a body line: its last base is INFO's END, or the last of its longest plain allele."""
    contig, pos, _, ref, alts, _, _, info = line.split("\t", 8)[:8]
    begin = int(pos) - 1
    own = _END.search(info)
    plain = [len(a) for a in (ref, *alts.split(",")) if not a.strip("ATGC")]
    return contig, begin, max(begin + max([1, len(ref), *plain]), int(own[1]) if own else 0)


def text_lines(values: Iterator[str]) -> Iterator[tuple[bytes, Place | None]]:
    return ((v.encode() + b"\n", None if v.startswith("#") else place_of(v)) for v in values)


def dictionaries(lines: Iterable[str]) -> tuple[dict[int, str], dict[int, str]]:
    """Names by number, of FILTER, INFO and FORMAT, and of contigs: an IDX counts, else the order of first sight."""
    names, contigs = {0: "PASS"}, {}
    nexts = [1, 0]
    for line in lines:
        m = re.match(r"##(FILTER|INFO|FORMAT|contig)=<(?:.*,)?ID=([^,>]+)", line)
        if not m:
            continue
        kind = int(m[1] == "contig")
        mine = (names, contigs)[kind]
        if m[2] in mine.values():
            continue
        own = re.search(r"[<,]IDX=(\d+)", line)
        number = int(own[1]) if own else nexts[kind]
        mine[number] = m[2]
        nexts[kind] = max(nexts[kind], number + 1)
    return names, contigs


def _typed(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _integers([n])


def _width(values: Iterable[int]) -> tuple[int, str, int]:
    own = list(values)
    low, high = min(own, default=0), max(own, default=0)
    for code, letter, missing, least, most in INTS:
        if least <= low and high <= most:
            return code, letter, missing
    raise ValueError(f"beyond 32 bits: {low} to {high}")


def _integers(values: list[int | None]) -> bytes:
    code, letter, missing = _width(v for v in values if v is not None)
    return _typed(code, len(values)) + struct.pack(f"<{len(values)}{letter}", *(missing if v is None else v for v in values))


def _text(s: str) -> bytes:
    raw = s.encode()
    return _typed(CHAR, len(raw)) + raw


def _float(s: str) -> bytes:
    return FLOAT_MISSING if s == "." else struct.pack("<f", float(s))


def _info(kind: str, value: str | None) -> bytes:
    if value is None or kind == "Flag":
        return b"\0"
    if kind == "Integer":
        return _integers([None if v == "." else int(v) for v in value.split(",")])
    if kind == "Float":
        own = value.split(",")
        return _typed(FLOAT, len(own)) + b"".join(map(_float, own))
    return _text(value)


def _call(v: str) -> list[int]:
    own, phased = [], 0
    for part in v.replace("|", "/|").split("/"):
        phased = int(part.startswith("|"))
        part = part.removeprefix("|")
        own.append((0 if part == "." else int(part) + 1) << 1 | phased)
    return own


def _numbers(v: str) -> list[int | None]:
    return [None if x == "." else int(x) for x in v.split(",")]


class Memo(dict):
    """What is made of short values, as they are met: most are met again. Emptied where they become many."""

    def __init__(self, make: Callable) -> None:
        self.make = make

    def __missing__(self, value):
        out = self.make(value)
        if len(value) <= 64:
            if len(self) >= 1 << 14:
                self.clear()
            self[value] = out
        return out


def _vectors(parse: Callable[[str], list[int | None]]) -> Callable[[Sequence[str]], bytes]:
    """Encodes an integer field of all samples: vectors of the longest one's length, shorter ones ended."""

    def packed(width: tuple, v: str) -> bytes | None:
        _, letter, missing, least, most = width
        own = parse(v)
        if any(x is not None and not least <= x <= most for x in own):
            return None
        return struct.pack(f"<{len(own)}{letter}", *(missing if x is None else x for x in own))

    memos = [Memo(partial(packed, width)) for width in INTS]

    def encode(values: Sequence[str]) -> bytes:
        for (code, letter, missing, _, _), memo in zip(INTS, memos, strict=True):
            own = [memo[v] for v in values]
            if None not in own:
                return _padded(code, own, struct.pack("<" + letter, missing + 1))
        _width(x for v in values for x in parse(v) if x is not None)  # says what is beyond
        raise AssertionError

    return encode


def _padded(code: int, own: list[bytes], end: bytes) -> bytes:
    sizes = {*map(len, own)}
    most = max(sizes)
    if len(sizes) > 1:
        own = [r + end * ((most - len(r)) // len(end)) for r in own]
    return _typed(code, most // len(end)) + b"".join(own)


def _columns(kinds: dict[str, str]) -> Callable[[str], Callable[[Sequence[str]], bytes]]:
    """What encodes a field of all samples, by its key."""
    floats = Memo(lambda v: b"".join(map(_float, v.split(","))))

    def texts(values: Sequence[str]) -> bytes:
        raw = [v.encode() for v in values]
        n = max(map(len, raw))
        return _typed(CHAR, n) + b"".join(r.ljust(n, b"\0") for r in raw)

    made = {"GT": _vectors(_call), "Integer": _vectors(_numbers), "Float": lambda values: _padded(FLOAT, [floats[v] for v in values], FLOAT_END)}
    return lambda key: made.get("GT" if key == "GT" else kinds.get(key, "String"), texts)


def bcf_records(header: Header, genotypes: bool = True) -> Callable[[Iterator[str]], Iterator[tuple[bytes, Place | None]]]:
    """Encodes VCF body lines: a whole BCF file for each task, header first."""
    lines = header.text(genotypes)
    names, contigs = dictionaries(lines)
    at, of_contig = {v: k for k, v in names.items()}, {v: k for k, v in contigs.items()}
    kinds, column = {k: f.type for k, f in header.info.items()}, _columns({k: f.type for k, f in header.formats.items()})
    text = "\n".join(lines).encode() + b"\n\0"

    def item(x: str) -> bytes:
        k, eq, v = x.partition("=")
        return _integers([at[k]]) + _info(kinds.get(k, "String"), v if eq else None)

    def encode(rows: Iterator[str]) -> Iterator[tuple[bytes, Place | None]]:
        yield b"BCF\x02\x02" + struct.pack("<I", len(text)) + text, None
        items, texts, filters = Memo(item), Memo(_text), Memo(lambda v: b"\0" if v == "." else _integers([at[x] for x in v.split(";")]))
        fields = Memo(lambda v: [(_integers([at[k]]), column(k)) for k in v.split(":")])
        for line in rows:
            f = line.split("\t")
            alleles = [f[3], *([] if f[4] == "." else f[4].split(","))]
            info = [] if f[7] == "." else f[7].split(";")
            keys = fields[f[8]] if len(f) > 9 else []
            end = next((x[4:] for x in info if x.startswith("END=")), None) if "END=" in f[7] else None
            shared = b"".join([texts[f[2]] if f[2] != "." else b"\x07", *[texts[x] for x in alleles], filters[f[6]], *[items[x] for x in info]])
            own = [s.split(":") for s in f[9:]]
            if own and min(map(len, own)) < len(keys):
                own = [s + ["."] * (len(keys) - len(s)) for s in own]
            each = b"".join([part for (number, made), values in zip(keys, zip(*own, strict=False), strict=False) for part in (number, made(values))])
            pos = int(f[1])
            fixed = struct.pack("<iii", of_contig[f[0]], pos - 1, int(end) - pos + 1 if end and end.isdigit() else len(f[3]))
            fixed += (FLOAT_MISSING if f[5] == "." else struct.pack("<f", float(f[5]))) + struct.pack("<II", len(alleles) << 16 | len(info), len(keys) << 24 | len(own))
            yield struct.pack("<II", len(fixed) + len(shared), len(each)) + fixed + shared + each, place_of(line)

    return encode
