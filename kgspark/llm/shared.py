"""Helpers that the corpus operators share: the shared folder, and words of many texts as numpy arrays."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import shared_folder, written  # noqa: F401

#: A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step works on; one longer document is worked on alone.
STEP_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **parts: Column) -> DataFrame:
    """The rows of df as one struct `row`, beside other columns: names inside can't clash with names of later steps."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), *(c.alias(name) for name, c in parts.items()))


def unpacked(columns: list[str], **new: Column) -> list[Column]:
    """The columns of `row` again, with new values for some."""
    return [new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns]


def pick(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, under new names and with given types; extra columns of the input can't clash."""
    return df.select(*(F.col(quoted(old)).alias(new) for new, old in columns.items()))


#: Bits of a filter for each of its values, and at most: beyond that it drops fewer rows, and the join behind it does the rest.
FILTER_SHARE, FILTER_BITS = 16, 1 << 26


def maybe_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows with `_maybe`: false only where no value of ids (a column of that name) equals the column's (null: false).

    A bit map of the hashed values, sized by their number and sent to all tasks; to drop rows without a partner before they are shuffled.
    """
    bits = min(FILTER_BITS, 1 << max(12, (FILTER_SHARE * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    words = ids.select(place.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_set"))
    at = rows.withColumn("_at", place).withColumn("_word", F.shiftright("_at", 6))
    out = at.join(F.broadcast(words), "_word", "left")  # at most FILTER_BITS / 64 rows
    hit = F.expr("coalesce((shiftright(_set, cast(_at & 63 as int)) & 1) = 1, false)") & F.col(column).isNotNull()
    return out.withColumn("_maybe", hit).drop("_at", "_word", "_set")


class Folder:
    """Files in a shared folder that tasks write, each whole under its name, and map into memory: from there where it is mounted, else from a copy."""

    def __init__(self, uri: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")

    def write(self, name: str, data: bytes) -> None:
        top = f"{self.path}/{name}"
        self.fs.create_dir(top.rsplit("/", 1)[0], recursive=True)
        part = f"{top}.{uuid.uuid4().hex}.part"
        with self.fs.open_output_stream(part) as f:
            f.write(data)
        self.fs.move(part, top)

    def names(self, folder: str) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.path}/{folder}", allow_not_found=True))
        return sorted(f"{folder}/{x.base_name}" for x in found if not x.base_name.endswith(".part"))

    def mapped(self, name: str) -> np.ndarray:
        if isinstance(self.fs, fs.LocalFileSystem):
            return np.memmap(f"{self.path}/{name}", np.uint8, "r").view(np.ndarray)
        with tempfile.TemporaryFile() as f, self.fs.open_input_stream(f"{self.path}/{name}") as there:  # a copy without a name; it goes with the worker
            shutil.copyfileobj(there, f)
            f.flush()
            return np.memmap(f, np.uint8, "r").view(np.ndarray)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings (null: empty) and their n+1 offsets, without copies where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        column = column.cast(pa.large_string())
        wide = np.int64
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents with about `most` bytes each, one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text."""
    for b in batches:
        _, at = utf8(b.column(b.schema.get_field_index(text)))
        for i, j in steps(at, most):
            yield b.slice(i, j - i)


_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n += -n % (STEP_BYTES * 2)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers = both[0], both[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)


def word_spans(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the number of words before it (n+1 counts)."""
    n = len(low)
    word = np.zeros(n + 2, np.int8)
    word[1:-1] = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = word[1:-1] & (word[:-2] ^ 1)
    last = word[1:-1] & (word[2:] ^ 1)
    cut = offsets[(offsets > 0) & (offsets < n)]  # a document's edge ends a word, too
    first[cut] = word[cut + 1]
    last[cut - 1] = word[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same wherever it stands."""
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the lower-cased texts, and the n+1 counts of words before each document."""
    low = lower(raw)
    starts, ends, counts = word_spans(low, offsets)
    return span_hashes(low, starts, ends), counts


def one_word_hash(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(word_hashes(raw, np.array([0, len(raw)]))[0][0])
