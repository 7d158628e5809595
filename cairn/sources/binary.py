"""Point clouds in .ply and .pcd files, ASCII or binary, by numpy record parsing.

Files come as Spark's ``binaryFile`` rows; one file is parsed by one task, many files
by many.  Only the points' own properties are read: position, colour, normal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.bounded import broadcast_if_small
from cairn.schemas import POINT, points

# Scalar types of the two formats.
PLY_TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
PLY_NAMES = {"red": "r", "green": "g", "blue": "b"}
PCD_NAMES = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz"}


def _table(names: list[str], kinds: list[str], body: bytes, count: int, ascii_: bool, order: str) -> pd.DataFrame:
    if ascii_:
        rows = np.array(body.split()[: count * len(names)], dtype="f8").reshape(count, len(names))
        return pd.DataFrame(rows, columns=names)
    record = np.dtype([(n, order + k) for n, k in zip(names, kinds)])
    return pd.DataFrame({n: v for n in names for v in [np.frombuffer(body, record, count)[n].astype("f8")]})


def parse_ply(data: bytes) -> pd.DataFrame:
    """Columns of the vertex element, which must be the first that has rows."""
    end = data.index(b"end_header")
    head, body = data[:end].decode("ascii", "replace").split("\n"), data[data.index(b"\n", end) + 1 :]
    form, element, count, names, kinds = "ascii", None, 0, [], []
    for line in head:
        word = line.split()
        if word[:1] == ["format"]:
            form = word[1]
        elif word[:1] == ["element"]:
            element = word[1]
            count = int(word[2]) if element == "vertex" else count
        elif word[:1] == ["property"] and element == "vertex":
            if word[1] == "list":
                raise ValueError("list properties of vertices are not supported")
            kinds.append(PLY_TYPES[word[1]])
            names.append(word[2])
    df = _table(names, kinds, body, count, form == "ascii", ">" if form == "binary_big_endian" else "<")
    for name, short in PLY_NAMES.items():
        if name in df:
            df[short] = df.pop(name) / (255.0 if kinds[names.index(name)] == "u1" else 1.0)
    return df


def unpacked(data: bytes, size: int) -> bytes:
    """LZF: a byte below 32 begins so many literals, any other a copy of what came before."""
    out, at = bytearray(), 0
    while at < len(data):
        first = data[at]
        at += 1
        if first < 32:
            out += data[at : at + first + 1]
            at += first + 1
            continue
        length = first >> 5
        if length == 7:
            length += data[at]
            at += 1
        back = ((first & 31) << 8) + data[at] + 1
        at, length = at + 1, length + 2
        if back > len(out):
            raise ValueError("damaged compressed data")
        part = out[-back:] if back <= length else out[-back : len(out) - back + length]
        out += (part * (length // len(part) + 1))[:length]
    if len(out) != size:
        raise ValueError("damaged compressed data")
    return bytes(out)


def parse_pcd(data: bytes) -> pd.DataFrame:
    """Columns of a .pcd (ascii, binary or compressed); packed rgb is taken apart.

    Fields of several values a point are passed over.
    """
    at = data.index(b"\nDATA ") + 1
    line_end = data.index(b"\n", at)
    head = {w[0]: w[1:] for w in (x.split() for x in data[:line_end].decode("ascii", "replace").split("\n")) if w}
    form, count, body = head["DATA"][0], int(head["POINTS"][0]), data[line_end + 1 :]
    if form not in ("ascii", "binary", "binary_compressed"):
        raise ValueError(f"unknown .pcd data {form!r}")
    kinds = ["<" + {"F": "f", "U": "u", "I": "i"}[t] + s for t, s in zip(head["TYPE"], head["SIZE"])]
    each = [int(c) for c in head.get("COUNT", ["1"] * len(kinds))]
    columns: dict[str, np.ndarray] = {}
    if form == "binary_compressed":
        packed, size = np.frombuffer(body, "<u4", 2).tolist()
        body, start = unpacked(body[8 : 8 + packed], size), 0
        for name, kind, n in zip(head["FIELDS"], kinds, each):  # field after field
            if n == 1:
                columns[name] = np.frombuffer(body, kind, count, start)
            start += np.dtype(kind).itemsize * n * count
    elif form == "binary":
        fields = [(f"{k}:{name}", kind, (n,)) for k, (name, kind, n) in enumerate(zip(head["FIELDS"], kinds, each))]
        rows = np.frombuffer(body, np.dtype(fields), count)
        columns = {f.split(":", 1)[1]: rows[f][:, 0] for f, _, (n,) in fields if n == 1}
    else:
        rows = np.array(body.split()[: count * sum(each)], "f8").reshape(count, sum(each))
        places = np.r_[0, np.cumsum(each)]
        columns = {name: rows[:, places[k]].astype(kinds[k]) for k, name in enumerate(head["FIELDS"]) if each[k] == 1}
    df = pd.DataFrame({name: v.astype("f8") for name, v in columns.items()})
    if "rgb" in columns:
        packed = np.ascontiguousarray(columns["rgb"])
        bits = packed.view("<u4") if packed.dtype == np.dtype("<f4") else packed.astype("u4")
        for shift, c in ((16, "r"), (8, "g"), (0, "b")):
            df[c] = ((bits >> shift) & 255) / 255.0
    return df.rename(columns=PCD_NAMES)


PARSERS = {".ply": parse_ply, ".pcd": parse_pcd}


#: Points of a file are numbered from its place among the files times this.
FILE_IDS = 1 << 40


def read_binary_cloud(spark: SparkSession, path: str, suffix: str, scene: Column | None = None) -> DataFrame:
    """POINT rows of .ply or .pcd files; ids count from 0 in the first file by name, from FILE_IDS in the next.

    ``scene`` is an expression over ``path``, a file's path; by default all are scene "0".
    A file is parsed by one task and may have 2 GB at most.
    """
    parse = PARSERS[suffix]
    names = [part.strip().split(" ")[0] for part in POINT.split(",")]

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for where, first, data in zip(batch.scene_id, batch["first"], batch.content):
                df = parse(bytes(data))
                df["scene_id"], df["point_id"] = where, np.arange(first, first + len(df))
                for c in names[2:]:
                    df[c] = df[c].astype(float) if c in df else None
                yield df[names]

    found = spark.read.format("binaryFile").load(path)
    # the driver has listed the files already; one task numbers their names
    place = found.select("path").withColumn("first", (F.row_number().over(W.orderBy("path")) - 1).cast("long") * F.lit(FILE_IDS))
    rows = found.join(broadcast_if_small(place), "path").withColumn("scene_id", scene if scene is not None else F.lit("0"))
    return points(rows.select("scene_id", "first", "content").mapInPandas(run, POINT))
