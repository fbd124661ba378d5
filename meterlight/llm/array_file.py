"""Named arrays in one file that tasks map into memory."""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

_ALIGN = 64
_opened: dict[str, dict[str, np.ndarray]] = {}


def write_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A JSON line with each array's type, shape and place, padded, then the arrays."""
    entries, at = {}, 0
    for name, array in arrays.items():
        entries[name] = [array.dtype.str, list(array.shape), at]
        at += -(-array.nbytes // _ALIGN) * _ALIGN
    head = json.dumps(entries).encode() + b"\n"
    head = head.rjust(-(-len(head) // _ALIGN) * _ALIGN)
    with open(path, "wb") as out:
        out.write(head)
        for array in arrays.values():
            out.write(array.tobytes().ljust(-(-array.nbytes // _ALIGN) * _ALIGN, b"\0"))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file as read-only views of its mapping, opened once per process."""
    if path not in _opened:
        with open(path, "rb") as file:
            head = file.readline()
        whole = np.memmap(path, np.uint8, "r")
        arrays = {}
        for name, (kind, shape, at) in json.loads(head).items():
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            at += len(head)
            arrays[name] = whole[at : at + size].view(kind).reshape(shape)
        _opened[path] = arrays
    return _opened[path]


def send_arrays(spark: SparkSession, name: str, arrays: dict[str, np.ndarray]) -> str:
    """Write a file on the driver and have Spark copy it to every executor; returns its name there."""
    folder = tempfile.mkdtemp(prefix="meterlight-")
    name = f"{name}-{os.path.basename(folder)}"
    write_arrays(f"{folder}/{name}", arrays)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def received_arrays(name: str) -> dict[str, np.ndarray]:
    """In a task: the arrays that the driver sent under this name."""
    return map_arrays(SparkFiles.get(name))
