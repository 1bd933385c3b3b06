"""Questions to shards: tasks send compressed blocks of keys to shards, each shard answers every block, and the answers come back
to the slice of texts that asked. No task reads another's whole state, whatever its size."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A block on its way to a shard. origin, begin and size: file, place and length of the asking slice's own data.
ASKED = "origin string, begin long, size long, shard int, blob binary"
ANSWERED = "origin string, begin long, size long, shard int, blob binary, n long, total long"


# -- files in the shared folder --------------------------------------------------------------------------------------------


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_arrays(uri: str, meta: dict, arrays: list[np.ndarray]) -> None:
    """One file, complete or absent: a second attempt of a task writes the same bytes."""
    fs, path = _file_system(uri)
    head = json.dumps(meta | {"arrays": [[a.dtype.str, len(a)] for a in arrays]}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in arrays:
            raw = a.tobytes()
            out.write(raw + b"\0" * (-len(raw) % 64))
    fs.move(part, path)


def read_arrays(uri: str) -> tuple[dict, list[np.ndarray]]:
    """Memory-mapped where the shared folder is mounted, else read."""
    fs, path = _file_system(uri)
    raw = np.memmap(path, np.uint8, "r") if fs.type_name == "local" else np.frombuffer(fs.open_input_file(path).read(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    meta, at, arrays = json.loads(raw[8 : 8 + n].tobytes()), 8 + n, []
    for kind, length in meta.pop("arrays"):
        size = np.dtype(kind).itemsize * length
        arrays.append(raw[at : at + size].view(kind))
        at += size + (-size % 64)
    return meta, arrays


def remove_file(uri: str) -> None:
    fs, path = _file_system(uri)
    fs.delete_file(path)


class Keeper:
    """The file in which a task keeps what it needs of its slices until the answers are there. Each attempt has a file of its own,
    whose name travels with the questions, so an attempt that runs again never meets the data of another."""

    def __init__(self, folder: str):
        self.uri, self.out, self.at = f"{folder}/kept-{uuid.uuid4().hex}", None, 0

    def keep(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            fs, path = _file_system(self.uri)
            fs.create_dir(os.path.dirname(path), recursive=True)
            self.out = fs.open_output_stream(path)
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return self.uri, begin, len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Kept:
    """Reads what keepers kept; the last file stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, begin: int, size: int) -> bytes:
        if uri != self.uri:
            if self.file is not None:
                self.file.close()
            fs, path = _file_system(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(size, begin)


# -- blocks ----------------------------------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    import zstandard

    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    planes = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + planes)


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for kind, length in json.loads(raw[4:at]):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, width * length, at).reshape(width, length).T).view(kind).ravel() if length else np.empty(0, kind))
        at += width * length
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, which pack well."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its entries), shards in order."""
    order = np.argsort(shard, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
        yield int(shard[part[0]]), part


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the place among them of each."""
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return sorted_keys[new], place


def asked(kept: tuple[str, int, int], blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(blobs)
    columns = [pa.array([kept[0]] * n, pa.string()), pa.array([kept[1]] * n, pa.int64()), pa.array([kept[2]] * n, pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([s for s, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names=["origin", "begin", "size", "shard", "blob"])


# -- shards ----------------------------------------------------------------------------------------------------------------


def text_bytes(texts: DataFrame, text_col: str = "text") -> int:
    return texts.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def answered(questions: DataFrame, n: int, answer) -> DataFrame:
    """questions: rows of ASKED, for n shards. answer(shard, blobs) gives, for one shard, the list of answers and two numbers that
    the shard reports. A shard is a partition of its own; its number of blocks follows from n."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["shard"], []).append(row)
        for shard, rows in held.items():
            answers, count, total = answer(shard, [r.pop("blob") for r in rows])
            first = np.arange(len(rows)) == 0
            columns = [pa.array([r[c] for r in rows], t) for c, t in (("origin", pa.string()), ("begin", pa.int64()), ("size", pa.int64()), ("shard", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(answers, pa.binary()), pa.array(np.where(first, count, 0)), pa.array(np.where(first, total, 0))], names=[c.split()[0] for c in ANSWERED.split(", ")])

    return questions.repartitionById(n, F.col("shard")).mapInArrow(run, ANSWERED)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query that runs inside go when it ends. Else they stay for as long as anything refers to its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def per_slice(answers: DataFrame, n: int, tell, schema: str) -> DataFrame:
    """tell(data that the slice kept, {shard: answer}) gives record batches; slices come together by their origin and place, in n
    tasks: their work is in what they kept, so the size of the answers must not set the number of tasks."""

    def run(batches):
        kept, now, found = Kept(), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                key = row["origin"], row["begin"], row["size"]
                if key != now and now is not None:
                    yield from tell(kept.read(*now), found)
                    found = {}
                now = key
                found[row["shard"]] = row["blob"]
        if now is not None:
            yield from tell(kept.read(*now), found)

    rows = answers.select("origin", "begin", "size", "shard", "blob")
    return rows.repartition(n, "origin", "begin").sortWithinPartitions("origin", "begin", "shard").mapInArrow(run, schema)
