"""A data source for BAM files: ``spark.read.format("bam").load(path)``.

BAM is a series of BGZF blocks, gzip members of at most 64 KB each.  With an index beside it (``.bai``) a file is read in a
partition for each reference that has alignments, and a filter on ``chrom`` skips the others' bytes; without an index, and for
unplaced reads, a file is one partition.  Start and end of the filter on ``pos`` narrow the range by the index's windows of 16 kb.

The option ``regions`` (chrom:start-end, counted from 0 and half open, separated by commas) reads what overlaps them, each alignment
once: with an index only from the windows of the regions on, some regions a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan

SCHEMA = """query_name string, flag int, chrom string, pos long, end long, mapq int, cigar string, sequence string, qualities array<int>, strand string,
n_soft_clipped_left int, n_soft_clipped_right int, sa string, mod_5mc_probs string"""
_BASES = "=ACMGRSVTWYHKDBN"
_OPS = "MIDNSHP=X"
_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}
WINDOW = 1 << 14


def methylation(sequence: str, reverse: bool, mm: str | None, ml: list[int] | None) -> str:
    """A character a base for 5mC: ``0`` without a call, else ``!`` plus the tenth of the probability.

    The MM tag counts skipped bases of the read as it was sequenced, ML has a byte for each call; a read with more than one list
    of 5mC calls is an error.
    """
    out = ["0"] * len(sequence)
    if not mm:
        return "".join(out)
    used, found = 0, 0
    as_read = [_PAIR.get(c, "N") for c in reversed(sequence)] if reverse else list(sequence)
    for part in filter(None, mm.split(";")):
        head, *skips = part.split(",")
        skips = [x for x in skips if x.strip()]  # a list without calls may still have its comma
        codes = head[2:].rstrip(".?")
        n = len(skips)
        names = [codes] if codes.isdigit() else list(codes)
        probs = (ml or [])[used : used + n * len(names)]
        used += n * len(names)
        if head[0] != "C" or "m" not in names:
            continue
        found += 1
        if found > 1:
            raise ValueError("more than one list of 5mC calls")
        base = "C" if head[1] == "+" else "G"
        places = [i for i, c in enumerate(as_read) if c == base]
        at = -1
        for k, skip in enumerate(skips):
            at += int(skip) + 1
            if at >= len(places) or k * len(names) + names.index("m") >= len(probs):
                break
            i = places[at]
            out[len(sequence) - 1 - i if reverse else i] = chr(int(probs[k * len(names) + names.index("m")] / 255 * 10) + 33)
    return "".join(out)


class Blocks:
    """Bytes of a BGZF file from a virtual offset on."""

    def __init__(self, file, voffset: int = 0):
        self.file, self.next, self.data, self.at, self.start = file, voffset >> 16, b"", 0, voffset >> 16
        if voffset & 0xFFFF:
            self._block()
            self.at = voffset & 0xFFFF

    def _block(self) -> bool:
        self.file.seek(self.next)
        head = self.file.read(18)
        if len(head) < 18:
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        size = struct.unpack_from("<H", head, 16)[0] + 1
        body = self.file.read(size - 18)
        self.start, self.next, self.at = self.next, self.next + size, 0
        self.data = zlib.decompress(body[extra - 6 :], -15)
        return True

    def tell(self) -> int:
        return self.next << 16 if self.at >= len(self.data) else self.start << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.data):
                if not self._block():
                    break
                continue
            part = self.data[self.at : self.at + n - len(out)]
            out, self.at = out + part, self.at + len(part)
        return out


def header(blocks: Blocks) -> list[tuple[str, int]]:
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def tags(raw: bytes) -> dict:
    out, at = {}, 0
    while at + 3 <= len(raw):
        name, kind, at = raw[at : at + 2].decode(), chr(raw[at + 2]), at + 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            out[name] = list(struct.unpack_from(f"<{n}{sub.replace('c', 'b').replace('C', 'B').replace('s', 'h').replace('S', 'H')}", raw, at + 5))
            at += 5 + n * _SIZES[sub]
        else:
            at += _SIZES[kind]
    return out


def record(raw: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", raw, at)
    at += 4 * n_ops
    packed = raw[at : at + (l_seq + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:l_seq]
    at += (l_seq + 1) // 2
    quals = list(raw[at : at + l_seq])
    if quals and quals[0] == 255:
        quals = []
    t = tags(raw[at + l_seq :])
    reverse = bool(flag & 0x10)
    span = sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8))
    clip = lambda i: ops[i] >> 4 if ops and ops[i] & 15 == 4 else 0
    return (
        raw[32 : 32 + l_name - 1].decode(), flag, names[ref] if ref >= 0 else None, pos, pos + max(span, 1), mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops),
        seq, quals, "-" if reverse else "+", clip(0), clip(-1), t.get("SA"), methylation(seq, reverse, t.get("MM", t.get("Mm")), t.get("ML", t.get("Ml"))),
    )


def index(raw: bytes) -> list[tuple[int, int, list[int]] | None]:
    """For each reference the first and last virtual offset and the first offset of each window, None if it has nothing."""
    if raw[:4] != b"BAI\x01":
        raise ValueError("not a BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        low, high = None, 0
        n_bins = struct.unpack_from("<i", raw, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", raw, at)
            at += 8
            for _ in range(n_chunks):
                a, b = struct.unpack_from("<QQ", raw, at)
                at += 16
                if number != 37450:
                    low, high = a if low is None else min(low, a), max(high, b)
        n = struct.unpack_from("<i", raw, at)[0]
        windows = list(struct.unpack_from(f"<{n}Q", raw, at + 4))
        at += 4 + 8 * n
        out.append(None if low is None else (low, high, windows))
    return out


class Part(InputPartition):
    """A stretch of a file, or ``regions`` (offset, low, high, where an alignment must start not to have been in the region before)."""

    def __init__(self, path: str, start: int | None, stop: int | None, chrom: str | None, regions: list[tuple[int, int, int, int]] | None = None):
        self.path, self.start, self.stop, self.chrom, self.regions = path, start, stop, chrom, regions


#: Regions nearer than this are read as one; regions a partition.
JOIN, REGIONS = 4 * WINDOW, 32


def merged(text: str) -> dict[str, list[tuple[int, int]]]:
    """The regions of each chromosome, ascending, near ones as one."""
    out: dict[str, list[tuple[int, int]]] = {}
    cut = [x.rpartition(":") for x in text.split(",") if x]
    for chrom, low, high in sorted((c, *map(int, r.split("-"))) for c, _, r in cut):
        own = out.setdefault(chrom, [])
        if own and low <= own[-1][1] + JOIN:
            own[-1] = (own[-1][0], max(own[-1][1], high))
        else:
            own.append((low, high))
    return out


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        prefix = path.rstrip("/")
        return sorted(f"{prefix}/{x.base_name}" for x in system.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".bam"))
    return [path]


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


class BamReader(DataSourceReader):
    def __init__(self, path: str, regions: str | None = None):
        self.path = path
        self.regions = merged(regions) if regions is not None else None
        self.chrom: str | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column == "chrom":
                self.chrom = f.value
            elif isinstance(f, GreaterThanOrEqual) and column == "pos":
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan) and column == "pos":
                self.high = min(self.high, f.value)
            yield f  # all are checked again: what is skipped here is only what can't match

    def partitions(self):
        out = []
        for path in _files(self.path):
            try:
                with _open(path + ".bai") as f:
                    entries = index(f.read())
            except (FileNotFoundError, OSError):
                out.append(Part(path, None, None, None))
                continue
            with _open(path) as f:
                names = [n for n, _ in header(Blocks(f))]
            for name, entry in zip(names, entries, strict=True):
                if entry is None or self.chrom not in (None, name):
                    continue
                low, high, windows = entry
                if self.regions is not None:
                    own, before = [], 0
                    for a, b in self.regions.get(name, []):
                        if a // WINDOW < len(windows):  # nothing stands beyond the last window
                            own.append((max(low, windows[a // WINDOW]), a, b, before))
                        before = b
                    out += [Part(path, None, None, name, own[i : i + REGIONS]) for i in range(0, len(own), REGIONS)]
                    continue
                w = min(self.low // WINDOW, len(windows) - 1) if windows else 0
                out.append(Part(path, max(low, windows[w]) if windows else low, high, name))
            if self.regions is None and self.chrom is None and self.low <= 0 and entries:
                ends = [e[1] for e in entries if e]
                out.append(Part(path, max(ends, default=None), None, ""))  # unplaced reads stand last
        return out or [Part(self.path, None, None, "", [])]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.regions == []:  # nothing to read
            return
        with _open(part.path) as f:
            blocks = Blocks(f)
            names = [n for n, _ in header(blocks)]
            if part.regions is not None:
                for at, low, high, before in part.regions:
                    blocks = Blocks(f, at)
                    while len(size := blocks.read(4)) == 4:
                        row = record(blocks.read(struct.unpack("<i", size)[0]), names)
                        if row[2] != part.chrom or row[3] >= high:
                            break
                        if row[4] > low and row[3] >= before:
                            yield row
                return
            if part.start is not None:
                blocks = Blocks(f, part.start)
            while part.stop is None or blocks.tell() < part.stop:
                size = blocks.read(4)
                if len(size) < 4:
                    return
                row = record(blocks.read(struct.unpack("<i", size)[0]), names)
                if part.chrom and row[2] == part.chrom and row[3] >= self.high:
                    return  # sorted by place
                if self.regions is not None and not any(row[3] < b and row[4] > a for a, b in self.regions.get(row[2], [])):
                    continue
                if part.chrom is None or (row[2] or "") == part.chrom:
                    yield row


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], self.options.get("regions"))


def register(spark) -> None:
    from tandem.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BamSource)
