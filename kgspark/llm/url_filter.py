"""Operator 10: URL filters with a sorted digest array.

The strings of a list become 64-bit xxhash digests in sorted arrays, beside the strings themselves: a file in the shared folder for each range of
digests, built once by one task. All tasks map the files into memory, probe all keys of a batch at once by binary search, and confirm each hit against the stored string,
so that colliding digests can't give a wrong verdict. URLs are neither moved nor joined, and a list of any length goes the same way. Rules (few, given as a
parameter) are kept in such an array, too: a URL probes it with each suffix of its host joined to each prefix of its path that a rule has the
length of.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. A null URL, or one without
`://`: both empty; it matches no rule, and the list only if that has the empty string. Null entries of a list are dropped, repeated ones count once. URLs of any length are judged whole. Repeated rows are kept. Extra
columns of the input are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Folder, pick, shared_folder, written

#: Entries of a range of digests, about.
SHARD_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # verdict, host, path


def digests_of(strings: Sequence[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


class DigestArray:
    """Sorted digests of strings, where each string ends, and the strings, in one run of bytes that may be mapped."""

    def __init__(self, raw: np.ndarray):
        n = int(raw[:8].view("<i8")[0])
        self.digests, self.at, self.text = raw[8 : 8 + 8 * n].view("<u8"), raw[8 + 8 * n : 16 + 16 * n].view("<i8"), raw[16 + 16 * n :]

    @staticmethod
    def coded(strings: Sequence[bytes]) -> bytes:
        digests = digests_of(strings)
        order = np.argsort(digests, kind="stable")
        at = np.zeros(len(strings) + 1, "<i8")
        np.cumsum([len(strings[i]) for i in order], out=at[1:])
        return np.array([len(strings)], "<i8").tobytes() + digests[order].astype("<u8").tobytes() + at.tobytes() + b"".join(strings[i] for i in order)

    def string(self, place: int) -> bytes:
        return self.text[self.at[place] : self.at[place + 1]].tobytes()

    def find(self, keys: Sequence[bytes], digests: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not len(keys):
            return found
        place = np.searchsorted(self.digests, digests)
        open_ = np.flatnonzero(place < len(self.digests))
        while len(open_):
            open_ = open_[self.digests[place[open_]] == digests[open_]]
            same = np.array([self.string(p) == keys[i] for i, p in zip(open_.tolist(), place[open_].tolist(), strict=True)], bool)
            found[open_[same]] = place[open_[same]]
            open_ = open_[~same]  # another string of the same digest stands here: look at the next entry
            place[open_] += 1
            open_ = open_[place[open_] < len(self.digests)]
        return found


class RuleArray:
    def __init__(self, rules: Sequence[Rule]):
        self.array = DigestArray(np.frombuffer(DigestArray.coded([f"{h}\n{p}".encode() for _, h, p in rules]), np.uint8))
        number: dict[bytes, int] = {}
        for r, (_, h, p) in enumerate(rules):
            number.setdefault(f"{h}\n{p}".encode(), r)
        self.number = [number[self.array.string(k)] for k in range(len(rules))]
        self.lengths = sorted({len(p) for _, _, p in rules})
        self.size = [(len(h) + len(p), len(h), -r) for r, (_, h, p) in enumerate(rules)]

    def longest(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Of each URL, the number of the longest rule that fits, or -1; of equally long ones, that of the longest host, then the first. Equal beginnings are looked up once."""
        most = self.lengths[-1] if self.lengths else 0
        urls: dict[tuple[str, str], int] = {}
        of = [urls.setdefault((h, p[:most]), len(urls)) for h, p in zip(hosts, paths, strict=True)]
        keys, owner = [], []
        for u, (host, path) in enumerate(urls):
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                some = [f"{suffix}\n{path[:n]}".encode() for n in self.lengths if n <= len(path)]
                keys += some
                owner += [u] * len(some)
        best = [-1] * len(urls)
        hits = self.array.find(keys, digests_of(keys))
        for i in np.flatnonzero(hits >= 0).tolist():
            r, u = self.number[hits[i]], owner[i]
            if best[u] < 0 or self.size[r] > self.size[best[u]]:
                best[u] = r
        return [best[u] for u in of]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def written_list(entries: DataFrame, shard_rows: int = SHARD_ROWS) -> tuple[str, int]:
    """entries (a string column key): the shared folder that has their digest arrays, a file for each range of digests, and how many bits number the ranges."""
    folder = shared_folder(entries.sparkSession)
    entries = written(pick(entries, {"key": "key"}).filter("key is not null").distinct(), folder, "entries")
    bits = max(0, int(entries.count() // shard_rows)).bit_length()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = digests_of([k.encode() for k in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_shard(d, bits))], names=["key", "shard"])

    def build(shard: pa.Table) -> pa.Table:
        Folder(folder).write(f"arrays/{shard.column('shard')[0].as_py()}", DigestArray.coded([k.encode() for k in shard.column("key").to_pylist()]))
        return shard.slice(0, 1).select(["shard"])

    entries.mapInArrow(dealt, "key string, shard long").groupBy("shard").applyInArrow(build, "shard long").count()
    return folder, bits


def _shard(digests: np.ndarray, bits: int) -> np.ndarray:
    return (digests >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(digests), np.int64)


def listed(keys: DataFrame, entries: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """keys: a DataFrame with a string column key. The same rows with `listed`: whether entries (a string column key) has that key."""
    folder, bits = written_list(entries, shard_rows)

    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        there = Folder(folder)
        arrays = {int(n.rsplit("/", 1)[1]): DigestArray(there.mapped(n)) for n in there.names("arrays")}
        for s in batches:
            some = [k.encode() for k in s.dropna()]
            d = digests_of(some)
            shard, hit = _shard(d, bits), np.zeros(len(some), bool)
            for x in np.unique(shard).tolist():
                at = np.flatnonzero(shard == x)
                if x in arrays:
                    hit[at] = arrays[x].find([some[i] for i in at.tolist()], d[at]) >= 0
            out = np.zeros(len(s), bool)
            out[s.notna().to_numpy()] = hit
            yield pd.Series(out)

    return keys.withColumn("listed", F.pandas_udf(probe, "boolean")("key"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], blocked: DataFrame, page_id: str = "page_id", url: str = "url", **limits: int) -> DataFrame:
    """blocked: a column `key` of hosts joined to paths. For each page: page_id, host, path, rule, listed, verdict (allow or block)."""
    rows = pick(pages, {"page_id": page_id, "url": url}).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        array = RuleArray(rules)
        for hosts, paths in batches:
            yield pd.Series(array.longest(hosts.tolist(), paths.tolist()), dtype="int32")

    number = F.pandas_udf(judge, "int")("host", "path")
    rows = listed(rows.withColumn("number", number).withColumn("key", F.concat("host", "path")), blocked, **limits)
    at = lambda values: F.try_element_at(F.array(*map(F.lit, values)).cast("array<string>"), F.col("number") + 1)
    rule = F.when(F.col("number") >= 0, at([h + p for _, h, p in rules] or [None]))
    verdict = F.when(F.col("number") >= 0, at([v for v, _, _ in rules] or [None])).when(F.col("listed"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


