"""Where the points of a binary or text point file lie: a small header scan, and the records of a range.

A layout tells the bytes at which records begin, how a record holds coordinates, and how many there
are, so that any run of records can be read and decoded by itself.
"""

from __future__ import annotations

import json
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

# Type names of the formats, as numpy codes.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "double": "f8",
}
PLY_ORDER = {"binary_little_endian": "<", "binary_big_endian": ">"}
PCD_TYPES = {"F": ("f4", "f8"), "I": ("i1", "i2", "i4", "i8"), "U": ("u1", "u2", "u4", "u8")}

#: How a file is read: its records by ranges, its lines by Spark's text source, or from its start to its end.
RECORDS, LINES, STREAM = "records", "lines", "stream"


class Layout(NamedTuple):
    """way: RECORDS, LINES or STREAM. records: their number; at: the byte of the first.

    kind: the record's fields as JSON [[code, repeats], ...], and xyz: which three fields hold the point.
    A record of STL holds three points (`points`). columns: the array lies column after column.
    For LINES, `at` is the number of header lines that aren't blank or comments.
    """

    way: str
    at: int
    records: int
    kind: str = "[]"
    xyz: str = "[]"
    points: int = 1
    columns: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(str(i), code, (n,)) for i, (code, n) in enumerate(json.loads(self.kind))])

    def decode(self, raw: bytes) -> np.ndarray:
        """(points, 3) of whole records."""
        data = np.frombuffer(raw, self.dtype)
        return np.stack([data[str(f)][:, i].astype(float) for f, i in json.loads(self.xyz)], axis=1).reshape(-1, 3)

    def read(self, f: BinaryIO, first: int, n: int) -> np.ndarray:
        """The points of the records first to first + n - 1."""
        if not self.columns:
            size = self.dtype.itemsize
            f.seek(self.at + first * size)
            if self.points == 1:
                return self.decode(_exactly(f, n * size))
            data = np.frombuffer(_exactly(f, n * size), self.dtype)
            return data[str(json.loads(self.xyz)[0][0])].astype(float).reshape(-1, 3)
        item = np.dtype(json.loads(self.kind)[0][0])
        out = []
        for c in range(3):
            f.seek(self.at + (c * self.records + first) * item.itemsize)
            out.append(np.frombuffer(_exactly(f, n * item.itemsize), item).astype(float))
        return np.stack(out, axis=1)


def _exactly(f: BinaryIO, n: int) -> bytes:
    raw = f.read(n)
    if len(raw) != n:
        raise ValueError(f"the file ends {n - len(raw)} bytes before its points do")
    return raw


def _xyz(names: list[str]) -> list[int]:
    low = [n.lower() for n in names]
    if missing := [c for c in "xyz" if c not in low]:
        raise ValueError(f"no field {', '.join(missing)}")
    return [low.index(c) for c in "xyz"]


def _fields(codes: list[tuple[str, int]], xyz: list[int]) -> dict:
    return {"kind": json.dumps(codes), "xyz": json.dumps([[i, 0] for i in xyz])}


def _lines(f: BinaryIO) -> Iterator[str]:
    while line := f.readline(1 << 20):
        yield line.decode("utf-8", "replace").strip()


def ply(f: BinaryIO, size: int) -> Layout:
    lines = _lines(f)
    if next(lines, "") != "ply":
        raise ValueError("not a PLY file")
    form, element, count, fields, read = "", "", None, [], 1
    for line in lines:
        words = line.split()
        read += bool(line) and not line.startswith("#")
        if words[:1] == ["end_header"]:
            break
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[:1] == ["property"] and element == "vertex" and words[1] != "list":
            fields.append((words[2], words[1]))
    else:
        raise ValueError("the PLY header has no end")
    if count is None:
        raise ValueError("the PLY file has no vertices")
    at = _xyz([n for n, _ in fields])
    if form == "ascii":
        return Layout(LINES, read, count, xyz=json.dumps([[i, 0] for i in at]))
    if form not in PLY_ORDER:
        raise ValueError(f"PLY format {form!r} is not known")
    for _, t in fields:
        if t not in PLY_TYPES:
            raise ValueError(f"PLY type {t!r} is not known")
    out = Layout(RECORDS, f.tell(), count, **_fields([(PLY_ORDER[form] + PLY_TYPES[t], 1) for _, t in fields], at))
    return out._replace(records=min(count, (size - out.at) // out.dtype.itemsize))  # a file cut short has fewer


def pcd(f: BinaryIO, size: int) -> Layout:
    head, read = {}, 0
    for line in _lines(f):
        if line and not line.startswith("#"):
            key, *values = line.split()
            head[key.upper()] = values
            read += 1
            if key.upper() == "DATA":
                break
    if "DATA" not in head or "FIELDS" not in head:
        raise ValueError("not a PCD file")
    names, count, form = head["FIELDS"], int(head["POINTS"][0]), head["DATA"][0].lower()
    xyz = _xyz(names)
    if form == "ascii":
        return Layout(LINES, read, count, xyz=json.dumps([[i, 0] for i in xyz]))
    if form != "binary":
        raise ValueError(f"PCD data {form!r} is not read")
    codes = []
    for width, kind, n in zip(head["SIZE"], head["TYPE"], head.get("COUNT", ["1"] * len(names))):
        code = kind.lower() + width
        if code not in PCD_TYPES.get(kind.upper(), ()):
            raise ValueError(f"PCD type {kind}{width} is not known")
        codes.append(("<" + code, int(n)))
    return Layout(RECORDS, f.tell(), count, **_fields(codes, xyz))


def stl(f: BinaryIO, size: int) -> Layout:
    """All vertices, three a facet, repeated where facets share them."""
    head = f.read(84)
    if len(head) == 84 and size == 84 + 50 * int.from_bytes(head[80:], "little"):
        codes = [("<f4", 3), ("<f4", 9), ("<u2", 1)]
        return Layout(RECORDS, 84, (size - 84) // 50, json.dumps(codes), json.dumps([[1, 0]]), points=3)
    return Layout(LINES, 0, 1 << 62, xyz=json.dumps([[1, 0], [2, 0], [3, 0]]))


def npy(f: BinaryIO, size: int, at: int = 0) -> Layout:
    f.seek(at)
    version = np.lib.format.read_magic(f)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    if version not in read:
        raise ValueError(f"NPY version {version} is not read")
    shape, columns, kind = read[version](f)
    if len(shape) != 2 or shape[1] != 3:
        raise ValueError("not an array of three columns")
    if kind.hasobject or kind.fields:
        raise ValueError(f"an array of {kind} is not read")
    codes, xyz = [(kind.str, 3)], [[0, 0], [0, 1], [0, 2]]
    return Layout(RECORDS, f.tell(), shape[0], json.dumps(codes), json.dumps(xyz), columns=bool(columns))


def npz(f: BinaryIO, size: int) -> Layout:
    """The first array of an archive: by ranges where it is stored as it is, else unpacked from start to end."""
    with zipfile.ZipFile(f) as archive:
        if not archive.infolist():
            raise ValueError("the archive is empty")
        first = archive.infolist()[0]
    if first.compress_type == zipfile.ZIP_STORED:
        f.seek(first.header_offset)
        name, extra = struct.unpack("<26xHH", f.read(30))
        return npy(f, size, first.header_offset + 30 + name + extra)
    with zipfile.ZipFile(f) as archive, archive.open(first) as inner:
        return npy_stream_head(inner)


class _NoSeek:
    """What is read of a stream, so far as to know where its header ends."""

    def __init__(self, f) -> None:
        self.f, self.n = f, 0

    def read(self, n: int) -> bytes:
        raw = self.f.read(n)
        self.n += len(raw)
        return raw

    def seek(self, at: int) -> None:
        assert at == self.n == 0

    def tell(self) -> int:
        return self.n


def npy_stream_head(f) -> Layout:
    return npy(_NoSeek(f), 0)._replace(way=STREAM)


def unpacked(f: BinaryIO, rows: int = 100_000) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, points) of the first array of a packed archive, some rows at a time.

    An array that lies column after column is held whole.
    """
    with zipfile.ZipFile(f) as archive:
        name = archive.infolist()[0]
        with archive.open(name) as inner:
            layout = npy_stream_head(inner)
            size = np.dtype(json.loads(layout.kind)[0][0]).itemsize
            if layout.columns:
                whole = np.frombuffer(_exactly(inner, 3 * size * layout.records), json.loads(layout.kind)[0][0])
                yield 0, whole.reshape(3, -1).T.astype(float)
                return
            for first in range(0, layout.records, rows):
                n = min(rows, layout.records - first)
                yield first, layout.decode(_exactly(inner, n * layout.dtype.itemsize))


BY_SUFFIX = {".ply": ply, ".pcd": pcd, ".stl": stl, ".npy": npy, ".npz": npz}
