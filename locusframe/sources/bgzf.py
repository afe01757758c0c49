"""Blocked gzip (BGZF) files as a splittable source of lines: VCF text and BCF 2, by ranges of compressed bytes or by index.

A range owns the blocks that begin in it. The first block of a range is looked for by its header and proved by inflating
it; text is then skipped through the first line feed, BCF is searched for the first bytes that parse as a whole record and
are followed by another. Each range reads on until the line or record that its last block began is whole, and checks that
it arrives where the next range begins: so no byte is owned twice or never, whatever the bytes look like.

With an index (CSI, or the older TBI), regions become ranges of virtual offsets, and only their blocks are inflated.
Paths must be ones that executors can open through pyarrow (a mounted folder, or a URI that it knows).
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship
from . import bcf, csi
from .header import Header

#: Compressed bytes of a range, and those that are read at once.
SPLIT, PIECE = 64 << 20, 1 << 20
#: Bytes of lines that travel together.
BATCH = 4 << 20
_MAGIC = b"\x1f\x8b\x08\x04"


def open_file(path: str):
    """A file for random access, and its size."""
    from pyarrow import fs

    if "://" in path:
        store, at = fs.FileSystem.from_uri(path)
    else:
        store, at = fs.LocalFileSystem(), path.removeprefix("file:")
    f = store.open_input_file(at)
    return f, f.size()


def block_size(data: bytes, at: int = 0) -> int | None:
    """How many bytes the block that begins there has; None where no block header stands, or not all of it."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    end = at + 12 + struct.unpack_from("<H", data, at + 10)[0]
    at += 12
    while at + 6 <= min(end, len(data)):
        kind, n = data[at : at + 2], struct.unpack_from("<H", data, at + 2)[0]
        if kind == b"BC" and n == 2:
            return struct.unpack_from("<H", data, at + 4)[0] + 1
        at += 4 + n
    return None


def unpack(block: bytes) -> bytes:
    """The contents of a whole block; an error where check sum or length differ."""
    extra = struct.unpack_from("<H", block, 10)[0]
    raw = zlib.decompress(memoryview(block)[12 + extra : -8], -15)
    check, n = struct.unpack_from("<II", block, len(block) - 8)
    if len(raw) != n or zlib.crc32(raw) != check:
        raise ValueError("damaged block")
    return raw


class Blocks:
    """The blocks of a file from a block's begin on: (offset, contents). ``count`` says how many were inflated."""

    def __init__(self, f, size: int, at: int) -> None:
        self.f, self.size, self.at, self.held, self.base, self.count = f, size, at, b"", at, 0

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        return self

    def __next__(self) -> tuple[int, bytes]:
        if self.at >= self.size:
            raise StopIteration
        for _ in range(2):
            own = self.at - self.base
            n = block_size(self.held, own)
            if n is not None and own + n <= len(self.held):
                break
            self.held, self.base = self.f.read_at(max(PIECE, 1 << 17), self.at), self.at
        else:
            raise ValueError(f"no block begins at {self.at}")
        offset = self.at
        self.at += n
        self.count += 1
        return offset, unpack(self.held[own : own + n])


def first_block(f, size: int, at: int) -> int:
    """Where the first block at or after a byte begins; the file's size where none does."""
    if at <= 0:
        return 0
    window = f.read_at(3 << 16, at) if at < size else b""
    found = window.find(_MAGIC)
    while 0 <= found < 1 << 16:
        n = block_size(window, found)
        if n and found + n <= len(window) and (at + found + n == size or block_size(window, found + n)):
            try:
                unpack(window[found : found + n])
                return at + found
            except (ValueError, zlib.error):
                pass
        found = window.find(_MAGIC, found + 1)
    return size


@dataclass
class Range(InputPartition):
    """Blocks from begin to end. inside: bytes to skip of the first block, where lines or records are known to begin there;
    until: bytes of the block at end that still belong to the range. None: found by the text, or up to the next range."""

    path: str
    begin: int
    end: int
    inside: int | None = None
    until: int | None = None
    whole: bool = False


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after the other, as a task costs more than a small range."""

    ranges: list[Range]


def together(ranges: Sequence[Range], tasks: int) -> list[Ranges]:
    """Neighbours share a task, up to SPLIT bytes and up to one of ``tasks`` equal parts of all; a larger range has its own."""
    most = min(SPLIT, sum(r.end - r.begin for r in ranges) // max(tasks, 1))
    out: list[Ranges] = []
    n = most
    for r in ranges:
        own = max(r.end - r.begin, 1)
        if not out or n + own > most:
            out.append(Ranges([]))
            n = 0
        out[-1].ranges.append(r)
        n += own
    return out


def _arrived(f, size: int, end: int, at: int) -> None:
    if (found := first_block(f, size, end)) != at:
        raise ValueError(f"blocks arrive at {at}, but the next range would begin at {found}: read the file unsplit")


def text_lines(r: Range, seen: list[int]) -> Iterator[bytes]:
    """The lines of a range, some whole ones at a time. seen gets the number of blocks that were inflated."""
    f, size = open_file(r.path)
    first = first_block(f, size, r.begin) if r.inside is None else r.begin
    blocks = Blocks(f, size, first)
    skip, drop = r.inside is None and r.begin > 0, r.inside or 0
    held: list[bytes] = []
    checked = first >= r.end and r.until is None
    if checked:
        return
    for offset, raw in blocks:
        if offset >= r.end and r.until is not None:
            # up to a virtual offset, where a line begins
            if offset == r.end and r.until:
                raw = raw[drop : r.until]
                held.append(raw[raw.find(b"\n") + 1 or len(raw) :] if skip else raw)
            break
        if offset >= r.end and not checked:
            _arrived(f, size, r.end, offset)
            checked = True
            if skip:
                break
        raw, drop = raw[drop:] if drop else raw, 0
        if skip:
            cut = raw.find(b"\n")
            if cut < 0:
                continue
            raw, skip = raw[cut + 1 :], False
        if checked:
            cut = raw.find(b"\n")
            held.append(raw if cut < 0 else raw[: cut + 1])
            if cut >= 0:
                break
            continue
        cut = raw.rfind(b"\n")
        if cut < 0:
            held.append(raw)
        else:
            held.append(raw[: cut + 1])
            yield b"".join(held)
            held = [raw[cut + 1 :]]
    if rest := b"".join(held):
        yield rest
    seen[0] += blocks.count


class _Records:
    """Inflated bytes with the virtual offset of each."""

    def __init__(self, blocks: Blocks) -> None:
        self.blocks, self.held, self.at, self.starts = blocks, bytearray(), 0, []

    def more(self) -> bool:
        got = next(self.blocks, None)
        if got is None:
            return False
        self.starts.append((len(self.held), got[0]))
        self.held += got[1]
        return True

    def need(self, n: int, at: int | None = None) -> bool:
        """Whether n bytes are there from a place on."""
        at = self.at if at is None else at
        while len(self.held) < at + n:
            if not self.more():
                return False
        return True

    def where(self) -> tuple[int, int]:
        """Virtual offset of the place: block and byte within it; the place behind the last block is the next one's begin."""
        if self.at >= len(self.held) and not self.need(1):
            return self.blocks.size, 0
        own = next(s for s in reversed(self.starts) if s[0] <= self.at)
        return own[1], self.at - own[0]

    def drop(self) -> None:
        """Let go of what is behind the place."""
        if self.at < 1 << 20:
            return
        keep = [i for i, s in enumerate(self.starts) if s[0] <= self.at][-1:]
        self.starts = self.starts[keep[0] if keep else 0 :]
        base = min(self.starts[0][0], self.at) if self.starts else self.at
        del self.held[:base]
        self.at -= base
        self.starts = [(s - base, c) for s, c in self.starts]


def first_record(f, size: int, begin: int, n_contigs: int, n_samples: int) -> tuple[int, int]:
    """Virtual offset of the first record that begins in a block at or after a byte; (size, 0) where none does."""
    first = first_block(f, size, begin)
    if first >= size:
        return size, 0
    own = _Records(Blocks(f, size, first))
    at = 0
    while own.need(32, at):
        step = bcf.record_size(own.held, at, n_contigs, n_samples)
        if step is not None and own.need(step, at) and bcf.is_record(own.held, at, n_contigs, n_samples):
            follows = at + step
            if not own.need(1, follows) or (own.need(32, follows) and bcf.record_size(own.held, follows, n_contigs, n_samples) is not None):
                own.at = at
                return own.where()
        at += 1
    return size, 0


def bcf_lines(r: Range, seen: list[int]) -> Iterator[list[str]]:
    """The records of a range as VCF lines."""
    f, size = open_file(r.path)
    own = _Records(Blocks(f, size, 0))
    text = bcf.header_of(own)
    head_blocks = own.blocks.count
    decode, n_contigs, n_samples = bcf.decoder(text)
    if r.inside is not None:
        own = _Records(Blocks(f, size, r.begin))
        own.need(r.inside)
        own.at = r.inside
    elif r.begin > 0:
        at, inside = first_record(f, size, r.begin, n_contigs, n_samples)
        own = _Records(Blocks(f, size, at))
        own.need(inside)
        own.at = inside
    stop = (r.end, r.until or 0)
    out: list[str] = []
    n = 0
    while (place := own.where()) < stop and place[0] < size:
        if not own.need(8):
            raise ValueError(f"a BCF file ends within a record: {r.path}")
        step = 8 + sum(struct.unpack_from("<II", own.held, own.at))
        if not own.need(step):
            raise ValueError(f"a BCF file ends within a record: {r.path}")
        out.append(decode(bytes(own.held[own.at : own.at + step])))
        n += len(out[-1])
        own.at += step
        own.drop()
        if n > BATCH:
            yield out
            out, n = [], 0
    if r.until is None and r.end < size and place[0] >= r.end and place != first_record(f, size, r.end, n_contigs, n_samples):
        raise ValueError(f"records arrive at {place}, but the next range would begin elsewhere: read the file unsplit")
    yield out
    seen[0] += own.blocks.count + (head_blocks if r.begin > 0 or r.inside is not None else 0)


def _unblocked(path: str) -> Iterator[list[str]]:
    """A BCF file that is plain or one gzip stream: read from its begin to its end, piece by piece."""
    f, size = open_file(path)
    out, n = [], 0
    for line in bcf.lines_of(bcf.Stream(bcf.inflated(f.read_at(PIECE, at) for at in range(0, size, PIECE)))):
        out.append(line)
        n += len(line)
        if n > BATCH:
            yield out
            out, n = [], 0
    yield out


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.kind, self.split, self.what = options["kind"], int(options.get("split", SPLIT)), options.get("what", "lines")
        self.files = json.loads(options["files"])
        self.regions = json.loads(options["regions"]) if "regions" in options else None
        self.overlap = options.get("overlap", "start")
        self.tasks = int(options["tasks"]) if "tasks" in options else None

    def _ranges(self, path: str) -> list[Range]:
        f, size = open_file(path)
        if block_size(f.read_at(64, 0)) is None:
            return [Range(path, 0, size, whole=True)]
        spans = [(0, None, size, None)]
        if self.regions is not None and (index := csi.load(path)) and (self.overlap == "start" or index.spans):
            spans = []
            names = index.names or bcf.contigs_of(bcf.header_of(_Records(Blocks(f, size, 0))))
            for begin, end in index.ranges([tuple(x) for x in self.regions], names):
                spans.append((begin >> 16, begin & 0xFFFF, end >> 16, end & 0xFFFF))
        out = []
        for begin, inside, end, until in spans:
            cuts = list(range(begin + self.split, end - self.split // 2, self.split))
            edges = [(begin, inside), *((c, None) for c in cuts), (end, until)]
            out += [Range(path, a, b, i, u) for (a, i), (b, u) in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def partitions(self) -> Sequence[InputPartition]:
        with ThreadPoolExecutor(16) as pool:
            ranges = [r for own in pool.map(self._ranges, self.files) for r in own]
        return ranges if self.tasks is None else together(ranges, self.tasks)

    def read(self, partition: Range | Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands out where there are no ranges
            return
        if isinstance(partition, Ranges):
            for r in partition.ranges:
                yield from self.read(r)
            return
        seen = [0]
        if partition.whole:
            made = _unblocked(partition.path)
        elif self.kind == "bcf":
            made = bcf_lines(partition, seen)
        else:
            made = (x.decode().removesuffix("\n").split("\n") for x in text_lines(partition, seen))
        if self.what == "blocks":
            n = sum(len(x) for x in made)
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([seen[0]], pa.int64()), pa.array([n], pa.int64())], ["file", "blocks", "lines"])
            return
        for lines in made:
            yield pa.RecordBatch.from_arrays([pa.array([x.removesuffix("\r") for x in lines], pa.string())], ["value"])


class BlockedLines(DataSource):
    """``value``: the lines of BGZF files. Options: files (a JSON list), kind (text or bcf), split (bytes of a range),
    regions (a JSON list of contig, first, last) and overlap, tasks (ranges share one up to such a part of all bytes);
    what=blocks gives (file, blocks, lines) of each range instead."""

    @classmethod
    def name(cls) -> str:
        return "blocked_lines"

    def schema(self) -> str:
        return "file string, blocks bigint, lines bigint" if self.options.get("what") == "blocks" else "value string"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, a folder or a glob, but for indexes, by Spark's own listing; nothing is read."""
    found = spark.read.format("binaryFile").load(path).select("path").collect()  # a row for each file
    return sorted(r.path for r in found if not r.path.endswith((".csi", ".tbi")))


def is_blocked(path: str) -> bool:
    """Whether the file can be opened here and begins with a block."""
    try:
        f, _ = open_file(path)
    except (OSError, ValueError):
        return False
    return block_size(f.read_at(64, 0)) is not None


def load(spark: SparkSession, files: list[str], kind: str = "text", split: int = SPLIT, regions: Sequence[tuple] | None = None, overlap: str = "start", what: str = "lines") -> DataFrame:
    """Lines of files, which may be far more than those of the regions: what the index cannot rule out is left to a filter."""
    ship(spark)
    spark.dataSource.register(BlockedLines)
    reader = spark.read.format("blocked_lines").option("files", json.dumps(files)).option("kind", kind).option("split", split).option("overlap", overlap).option("what", what).option("tasks", 4 * spark.sparkContext.defaultParallelism)
    return (reader if regions is None else reader.option("regions", json.dumps([list(r) for r in regions]))).load()


def text_header(path: str) -> Header:
    """Of the first blocks of a VCF file, as far as it goes."""
    f, size = open_file(path)
    held = b""
    for _, raw in Blocks(f, size, 0):
        held += raw
        at = 0 if held.startswith(b"#CHROM") else held.find(b"\n#CHROM")
        if at >= 0 and held.find(b"\n", at + 1) > 0:
            break
    return Header.parse(x for x in held.decode().split("\n") if x.startswith("#"))
