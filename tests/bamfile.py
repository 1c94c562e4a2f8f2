"""Writes small BAM files for tests."""

import struct
import zlib

OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"


def block(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return struct.pack("<BBBBIBBHBBHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, ref, pos, cigar, seq, quals, flag=0, tags=b""):
    ops = [(int(n), o) for n, o in cigar]
    packed = bytearray()
    codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    for i in range(0, len(codes), 2):
        packed.append(codes[i] << 4 | codes[i + 1])
    raw = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 4680, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    raw += b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops) + bytes(packed) + bytes(quals) + tags
    return struct.pack("<i", len(raw)) + raw


def write(path, contigs, records, index=False):
    """``records``: (reference number, bytes), sorted.  Blocks hold 3 records."""
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs))
    for name, length in contigs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    out, spans = block(head), {}
    for i in range(0, len(records), 3):
        at, data = len(out), b""
        for ref, raw in records[i : i + 3]:
            first = spans.setdefault(ref, [at << 16 | len(data), 0])
            data += raw
            first[1] = at << 16 | len(data)
        out += block(data)
    path.write_bytes(out + block(b""))
    if index:
        bai = b"BAI\x01" + struct.pack("<i", len(contigs))
        for i in range(len(contigs)):
            if i in spans:
                bai += struct.pack("<iIiQQ", 1, 4681, 1, *spans[i]) + struct.pack("<iQ", 1, spans[i][0])
            else:
                bai += struct.pack("<ii", 0, 0)
        path.with_suffix(".bam.bai").write_bytes(bai)
