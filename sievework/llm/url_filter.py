"""URL filters by a memory-mapped sorted digest array (operator 6).

A rule is a host and a path prefix, `host/path`: it fits urls of that host and its subdomains whose path starts with
its path. Rules and blocked hosts become keys; the keys' 64-bit xxhash digests are sorted into one array, with the
full strings beside it. The array is written once to the shared folder, shipped to the executors as a Spark file and
memory-mapped there, so that all Python workers of an executor share its pages.

A batch of urls is judged by building the keys that could fit (each host suffix with each length of path that some
rule has), searching all their digests in the array at once, and comparing the stored strings with the key, so that
two strings with the same digest are never taken for each other. The longest rule that fits decides. A url that no
rule fits is blocked if its host, or a domain it belongs to, is on the list of blocked hosts, and allowed otherwise.

Null urls, and urls without `://`, have empty host and path and are allowed. Rows are returned one for one, repeats
too; an empty table gives an empty result; an empty rule list blocks nothing but blocked hosts.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, filesystem, shared_dir, table

#: The rules of the query, (verdict, rule).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Hosts that the query's method blocks with their subdomains: advert, betting, pill and spam farms by name.
BLOCKED_HOSTS = [f"{name}.example.{top}" for name in ("ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def digest_file(keys: list[bytes], payload: list[int], lengths: list[int]) -> bytes:
    """Header, sorted digests, start of each string, payloads, strings. Lengths are those of the paths in the rules."""
    digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    order = np.argsort(digest, kind="stable")
    texts = [keys[i] for i in order]
    ends = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    head = struct.pack("<qq", len(keys), len(lengths)) + np.array(lengths, np.int64).tobytes()
    return head + digest[order].tobytes() + ends.tobytes() + np.array(payload, np.int64)[order].tobytes() + b"".join(texts)


class DigestArray:
    """The memory-mapped file of digest_file()."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.lengths = raw[at : at + 8 * k].view(np.int64).tolist()
        at += 8 * k
        self.digest = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.payload = raw[at : at + 8 * n].view(np.int64)
        self.texts = raw[at + 8 * n :]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Payload of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digest) or not keys:
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digest, wanted)
        for i in np.flatnonzero(self.digest[np.minimum(at, len(self.digest) - 1)] == wanted):
            j = at[i]
            while j < len(self.digest) and self.digest[j] == wanted[i]:
                if self.texts[self.ends[j] : self.ends[j + 1]].tobytes() == keys[i]:
                    out[i] = self.payload[j]
                    break
                j += 1
        return out


def build(spark: SparkSession, rules: list[tuple[str, str]], blocked_hosts: list[str]) -> str:
    """Write the digest array to the shared folder and ship it; returns the name for SparkFiles.get()."""
    keys, payload, lengths = [], [], set()
    for i, (_, rule) in enumerate(rules):
        host, _, path = rule.partition("/")
        keys.append(b"r" + host.encode() + b"/" + path.encode())
        payload.append(i)
        lengths.add(len(path) + 1)
    for host in blocked_hosts:
        keys.append(b"h" + host.encode())
        payload.append(0)
    data = digest_file(keys, payload, sorted(lengths))
    name = f"url-digests-{hashlib.sha256(data).hexdigest()[:24]}"
    fs, p = filesystem(spark, f"{shared_dir(spark)}/{name}")
    if not fs.exists(p):
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()
    spark.sparkContext.addFile(p.toString())
    return name


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def judge(pages: DataFrame, rules: list[tuple[str, str]], blocked_hosts: list[str]) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every row."""
    name = build(pages.sparkSession, rules, blocked_hosts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for b in batches(it, 1 << 20):
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            keys, row, is_host = [], [], []
            for i, (host, path) in enumerate(parts):
                start = 0
                while host:
                    suffix = host[start:]
                    keys.append(b"h" + suffix.encode())
                    row.append(i)
                    is_host.append(True)
                    for n in array.lengths:
                        if len(path) >= n:
                            keys.append(b"r" + (suffix + path[:n]).encode())
                            row.append(i)
                            is_host.append(False)
                    start = host.find(".", start) + 1
                    if not start:
                        break
            found = array.find(keys)
            best: list[int | None] = [None] * len(parts)
            listed = [False] * len(parts)
            for k in np.flatnonzero(found >= 0):
                i, rule = row[k], int(found[k])
                if is_host[k]:
                    listed[i] = True
                elif best[i] is None or len(rules[rule][1]) > len(rules[best[i]][1]):
                    best[i] = rule
            verdict = [rules[r][0] if r is not None else "block" if bad else "allow" for r, bad in zip(best, listed, strict=True)]
            yield pa.record_batch([b.column(0), pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts]), pa.array([None if r is None else rules[r][1] for r in best], pa.string()), pa.array(verdict)], ["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, BLOCKED_HOSTS)


def oracle_sql() -> str:
    values = ", ".join(f"('{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH rules(verdict, rule, rhost, rpath) AS (VALUES {values}), hosts(h) AS (VALUES {hosts}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
fit AS (SELECT p.page_id, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict FROM p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath) GROUP BY p.page_id),
bad AS (SELECT DISTINCT p.page_id FROM p JOIN hosts ON p.host = h OR ends_with(p.host, '.' || h))
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id LEFT JOIN bad ON p.page_id = bad.page_id"""
