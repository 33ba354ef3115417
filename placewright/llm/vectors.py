"""Vectors in Arrow batches, and arrays in files of the shared folder."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.llm.common import file_system

NO_ID = -(1 << 63)


def dimension(df: DataFrame, vector: str) -> int:
    """The length of the longest vector, 1 at least."""
    return max(1, df.agg(F.max(F.size(df[vector]))).first()[0] or 0)


def doubles(column: Column) -> Column:
    return column.cast("array<double>")


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list column as rows of doubles that end in zeros up to ``dim``; and which are finite throughout and not null."""
    null = np.array(column.is_null(), dtype=bool)
    offsets = column.offsets.to_numpy().astype(np.int64)
    lengths = np.where(null, 0, np.diff(offsets))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    row = np.repeat(np.arange(len(null)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(null), dim))
    out[row, at] = values[np.repeat(offsets[:-1], lengths) + at]
    return out, ~null & np.isfinite(out).all(axis=1)


def put(folder: str, **arrays: np.ndarray) -> str:
    """Write arrays as one file of a new name into ``folder``. It counts only once a table names it, so repeated tasks do no harm."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    name, data = uuid.uuid4().hex, io.BytesIO()
    np.savez(data, **arrays)
    with system.open_output_stream(f"{root}/{name}") as file:
        file.write(data.getbuffer())
    return name


def get(folder: str, name: str) -> dict[str, np.ndarray]:
    system, root = file_system(folder)
    with system.open_input_file(f"{root}/{name}") as file, np.load(io.BytesIO(file.read())) as arrays:
        return dict(arrays)


class Held:
    """The last few files that a task has read."""

    def __init__(self, folder: str, size: int, made=lambda arrays: arrays):
        self.folder, self.size, self.made, self.files = folder, size, made, {}

    def __getitem__(self, name: str):
        value = self.files.pop(name) if name in self.files else self.made(get(self.folder, name))
        while len(self.files) >= self.size:
            self.files.pop(next(iter(self.files)))
        self.files[name] = value
        return value
