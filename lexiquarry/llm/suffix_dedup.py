"""Removal of repeated byte strings by suffix sorting with a difference cover.

A byte goes if a 50-byte string covering it also starts in a document with a smaller doc_id. Sorting every
suffix of a corpus costs many times its size, so only suffixes that can repeat are sorted:

1. Of documents with equal texts only the first is cut; the others' bytes all repeat.
2. Anchors: in each 50-byte window the 20-byte string of least hash. Equal windows have equal anchors, so a
   window repeats only if its anchor's hash occurs in another document. Distinct hashes, merged by task,
   meet in shards; what occurs once drops out.
3. Each remaining window belongs to one anchor. The bytes under an anchor's windows are sent to the shard
   of its hash. Copies of those bytes are merged before and after the shuffle, and only where different
   surroundings share an anchor are suffixes sorted.
4. Sorting is blockwise: a sample of positions, those whose residue lies in a difference cover modulo 31, is
   ranked first; then one bucket of suffixes (by leading bytes) is sorted at a time by its first 32 bytes,
   and ties beyond are resolved by the ranks of two sample positions at the same distance ahead, by ternary
   partition around a pivot. Memory is bounded by a shard's bytes plus one bucket. Neighbours in suffix order
   that share 50 bytes form a class; the windows of all but its smallest document repeat.

Documents are dealt into groups and anchors into shards of bounded size, counted from the input.

Defined results: a null text is empty. A text below 50 bytes keeps all. A row without doc_id keeps all and
removes nothing elsewhere. Rows with the same doc_id don't remove from each other. Equal rows have equal
results. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import materialize, partitions

DEPTH = 50
ANCHOR = 20
SPAN = DEPTH - ANCHOR + 1
#: Every difference modulo 31 is one of two of these residues.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- suffix sorting ------------------------------------------------------------------------------------


def _words(text: np.ndarray, starts: np.ndarray, count: int) -> list[np.ndarray]:
    """The bytes from each start as `count` big-endian 64-bit words; text is padded beyond its end."""
    out = []
    for w in range(count):
        word = np.zeros(len(starts), np.uint64)
        for k in range(8):
            word = (word << np.uint64(8)) | text[starts + (8 * w + k)].astype(np.uint64)
        out.append(word)
    return out


class CoverSample:
    """Ranks, to DEPTH bytes, of the positions of a text whose residue is in the difference cover."""

    def __init__(self, text: np.ndarray, cover=COVER, period=PERIOD, depth=DEPTH):
        self.period, self.depth, self.size = period, depth, len(text)
        self.text = np.concatenate([text, np.zeros(depth + period + 64, np.uint8)])
        inside = np.zeros(period, bool)
        inside[list(cover)] = True
        at = np.flatnonzero(inside[np.arange(len(text) + period) % period])
        keys = _words(self.text, at, -(-depth // 8))
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        self.rank = np.full(len(text) + period, -1, np.int32)
        self.rank[at[order]] = np.cumsum(new, dtype=np.int32)
        # ahead[r, s]: the least distance that brings both residues into the cover
        r = np.arange(period)
        hit = inside[(r[:, None] + r[None, :]) % period]  # hit[residue, distance]
        self.ahead = (hit[:, None, :] & hit[None, :, :]).argmax(axis=2)

    def sort(self, starts: np.ndarray, most: int = 1 << 20) -> np.ndarray:
        """starts in suffix order, sorted bucket by bucket; a bucket is a range of leading byte pairs."""
        lead = self.text[starts].astype(np.int32) << 8 | self.text[starts + 1]
        ends = np.cumsum(np.bincount(lead, minlength=65536))
        parts, lo = [], 0
        while lo < 65536:
            below = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, below + most, "right")))
            bucket = starts[(lead >= lo) & (lead < hi)]
            if len(bucket):
                parts.append(self._sort_bucket(bucket))
            lo = hi
        return np.concatenate(parts) if parts else starts

    def _sort_bucket(self, starts: np.ndarray) -> np.ndarray:
        keys = _words(self.text, starts, 4)
        order = np.lexsort(keys[::-1])
        starts = starts[order]
        tie = np.zeros(len(starts), bool)
        tie[1:] = True
        for k in keys:
            k = k[order]
            tie[1:] &= k[1:] == k[:-1]
        group = np.cumsum(~tie)
        active = np.flatnonzero(tie | np.append(tie[1:], False))
        while len(active):
            s, g = starts[active], group[active]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            sizes = np.diff(np.append(first, len(g)))
            pivot = np.repeat(s[first + sizes // 2], sizes)
            d = self.ahead[s % self.period, pivot % self.period]
            side = np.sign(self.rank[s + d].astype(np.int64) - self.rank[pivot + d])
            turn = np.lexsort((side, g))
            starts[active] = s[turn]
            g, side = g[turn], side[turn]
            sub = np.append(True, (g[1:] != g[:-1]) | (side[1:] != side[:-1]))
            label = np.cumsum(sub)
            count = np.bincount(label)[label]
            # a part equal to its pivot is done, and so is a part of one
            left = (side != 0) & (count > 1)
            # labels need only keep parts of this round apart and in order within their places
            group[active] = label
            active = active[left]
        return starts


def equal_windows(text: np.ndarray, starts: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """starts in suffix order, and the number of each one's class of equal depth-byte strings."""
    sample = CoverSample(text, depth=depth)
    order = sample.sort(starts)
    words = _words(sample.text, order, -(-depth // 8))
    spare = 8 * len(words) - depth
    words[-1] >>= np.uint64(8 * spare)
    new = np.zeros(len(order), bool)
    for w in words:
        new[1:] |= w[1:] != w[:-1]
    return order, np.cumsum(new)


# --- anchors -------------------------------------------------------------------------------------------


def _hashes(raw: np.ndarray, n: int = ANCHOR) -> np.ndarray:
    """A hash of the n bytes from each position, by doubling."""
    with np.errstate(over="ignore"):
        part, factor, size = raw.astype(np.uint64) + np.uint64(1), _ODD, 1
        out, taken = None, 0
        while True:
            if n & size:
                if out is None:
                    out = part
                else:
                    m = len(raw) - taken - size + 1
                    out = out[:m] * factor + part[taken : taken + m]
                taken += size
            if 2 * size > n:
                break
            part, factor, size = part[:-size] * factor + part[size:], np.uint64(factor * factor), 2 * size
        x = out ^ (out >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _slide(a: np.ndarray, w: int, op) -> np.ndarray:
    n = 1
    m = len(a) - w + 1
    while 2 * n <= w:
        a = op(a[:-n], a[n:])
        n *= 2
    return op(a[:m], a[w - n : w - n + m]) if n < w else a[:m]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes at all positions, the least in each window, and the positions that are least in some window."""
    h = _hashes(raw)
    least = _slide(h, SPAN, np.minimum)
    pad = np.zeros(SPAN - 1, np.uint64)
    chosen = np.flatnonzero(_slide(np.concatenate([pad, least, pad]), SPAN, np.maximum) == h)
    return h, least, chosen


def owners(h: np.ndarray, least: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, last window): the windows in which that anchor is the leftmost of least hash."""
    at = np.searchsorted(chosen, np.arange(len(least)))
    wrong = np.flatnonzero(h[chosen[at]] != least)
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    return chosen[at[first]], first, np.append(first[1:], len(least)) - 1


# --- tables in bytes -----------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; integers by byte planes."""
    import zstandard

    parts = []
    for a in arrays:
        body = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        parts += [struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)), body]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sI", raw, at)
        dtype = np.dtype(kind.decode())
        body = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 6)
        out.append(np.ascontiguousarray(body.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype))
        at += 6 + n * dtype.itemsize
    return out


def _sorted_pack(h: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending hashes as differences, with other arrays."""
    return _pack(np.append(h[:1], np.diff(h)), *more)


def _by(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of an ascending key."""
    if len(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
        for a, b in zip(first, first[1:] + [len(key)]):
            yield int(key[a]), slice(a, b)


# --- stages --------------------------------------------------------------------------------------------

def _frame(rows: list[tuple], columns: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=columns) if rows else pd.DataFrame({c: pd.Series(dtype="object") for c in columns})


def _scan(shards: int, most: int):
    """Batches of documents to hashes for the shards. If several documents here share a hash, it is sent once
    and their bins are told at once (as target -1 - bin), so that no hash is sent by every document."""

    def flush(held):
        h = np.concatenate([x for x, _ in held])
        home = np.repeat(np.array([b for _, b in held], np.int32), [len(x) for x, _ in held])
        order = np.argsort(h, kind="stable")
        h, home = h[order], home[order]
        new = np.append(True, h[1:] != h[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h))) > 1
        here = many[np.cumsum(new) - 1]
        told, bins = h[here], home[here]
        order = np.argsort(bins, kind="stable")
        told, bins = told[order], bins[order]
        out = [(-1 - b, _sorted_pack(np.unique(told[run]))) for b, run in _by(bins)]
        h, home = h[first], home[first]
        shard = (h % np.uint64(shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        h, home, many, shard = h[order], home[order], many[order], shard[order]
        out += [(s, _sorted_pack(h[run], home[run], many[run].astype("u1"))) for s, run in _by(shard)]
        return _frame(out, ["target", "load"])

    def run(batches: Iterator):
        held, size = [], 0
        for pdf in batches:
            for b, raw in zip(pdf["bin"], pdf["raw"]):
                h, _, chosen = anchors(np.frombuffer(raw, np.uint8))
                held.append((np.unique(h[chosen]), b))
                size += len(held[-1][0])
                if size > most:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _match(key, pdf):
    """Of a shard's hashes, those of several documents, by bin. What is addressed to a bin passes."""
    if key[0] < 0:
        return _frame([(-1 - key[0], x) for x in pdf["load"]], ["bin", "load"])
    parts = [_unpack(x) for x in pdf["load"]]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    home = np.concatenate([p[1] for p in parts])
    many = np.concatenate([p[2] for p in parts]) > 0
    order = np.argsort(h, kind="stable")
    h, home, many = h[order], home[order], many[order]
    number = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1
    shared = (np.bincount(number) > 1)[number] & ~many
    h, home = h[shared], home[shared]
    order = np.argsort(home, kind="stable")
    h, home = h[order], home[order]
    return _frame([(b, _sorted_pack(np.unique(h[run]))) for b, run in _by(home)], ["bin", "load"])


def _members(left, right):
    """A bin's documents that take part, in the order that gives them their numbers."""
    left = left.drop_duplicates(["doc_id", "tag"])
    gone = right[right["load"].isna()]
    if len(gone):
        out = set(zip(gone["doc_id"].astype("int64"), gone["tag"].astype("int64")))
        left = left[[x not in out for x in zip(left["doc_id"], left["tag"])]]
    return left.sort_values(["doc_id", "tag"])


def _surround(shards: int):
    """The bytes under the windows of shared anchors, for the shards; what repeats within the bin is settled here."""

    def run(key, left, right):
        import pandas as pd

        left = _members(left, right)
        told = right["load"].dropna()
        if not len(left) or not len(told):
            return _frame([], ["target", "load"])
        known = np.unique(np.concatenate([np.cumsum(_unpack(x)[0], dtype=np.uint64) for x in told]))
        hs, rows, offs, los, lens, pieces = [], [], [], [], [], []
        for row, raw in enumerate(left["raw"]):
            h, least, chosen = anchors(np.frombuffer(raw, np.uint8))
            p, lo, hi = owners(h, least, chosen)
            at = np.minimum(np.searchsorted(known, h[p]), len(known) - 1)
            keep = known[at] == h[p]
            p, lo, hi = p[keep], lo[keep], hi[keep]
            hs.append(h[p])
            rows.append(np.full(len(p), row, np.int32))
            offs.append((p - lo).astype(np.uint8))
            los.append(lo.astype(np.uint32))
            lens.append((hi - lo + 1).astype(np.uint8))
            pieces += [raw[a:z] for a, z in zip(lo.tolist(), (hi + DEPTH).tolist())]
        h, row, off, lo, n = map(np.concatenate, (hs, rows, offs, los, lens))
        if not len(h):
            return _frame([], ["target", "load"])
        ids = left["doc_id"].to_numpy(np.int64)[row]
        # The first document with the same bytes speaks for all; those of others repeat.
        number = pd.factorize(pd.Series([x + bytes([o]) for x, o in zip(pieces, off.tolist())]))[0]
        first = np.full(number.max() + 1, -1, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        gone = ids > ids[first][number]
        out = []
        if gone.any():
            out.append((-1 - key[0], _pack(row[gone], lo[gone], n[gone])))
        stay = np.flatnonzero(~gone)
        shard = (h[stay] % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((h[stay], shard))
        stay, shard = stay[order], shard[order]
        home = np.full(1, key[0], np.int32)
        for s, part in _by(shard):
            k = stay[part]
            body = np.frombuffer(b"".join([pieces[i] for i in k.tolist()]), np.uint8)
            out.append((s, _sorted_pack(h[k], home, ids[k], row[k], lo[k], n[k], off[k], body)))
        return _frame(out, ["target", "load"])

    return run


def _settle(key, pdf):
    """Which windows of a shard repeat a smaller document's; by bin, as (document's number, first window, windows)."""
    import pandas as pd

    if key[0] < 0:
        return _frame([(-1 - key[0], x) for x in pdf["load"]], ["bin", "load"])
    parts = [_unpack(x) for x in pdf["load"]]
    h = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    home = np.concatenate([np.full(len(p[0]), p[1][0], np.int32) for p in parts])
    ids, row, lo, n, off, body = (np.concatenate([p[k] for p in parts]) for k in range(2, 8))
    size = n.astype(np.int64) + DEPTH - 1
    start = np.cumsum(size) - size
    raw = body.tobytes()
    number = pd.factorize(pd.Series([raw[a : a + s] + bytes([o]) for a, s, o in zip(start.tolist(), size.tolist(), off.tolist())]))[0]
    least = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, ids)
    whole = ids > least[number]
    out = [(home[whole], row[whole], lo[whole], n[whole])]
    # Suffixes are sorted where an anchor has different bytes around it.
    head = np.zeros(len(least), np.int64)
    head[number] = np.arange(len(number))
    _, which, times = np.unique(h[head], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(~whole & (times[which] > 1)[number])
    if len(mixed):
        text = np.concatenate([body[a : a + s] for a, s in zip(start[mixed].tolist(), size[mixed].tolist())])
        base, counts = np.cumsum(size[mixed]) - size[mixed], n[mixed].astype(np.int64)
        owner = np.repeat(np.arange(len(mixed)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        starts = base[owner] + within
        window_at = np.full(len(text), -1, np.int64)
        window_at[starts] = np.arange(len(starts))
        order, equal = equal_windows(text, starts)
        window = window_at[order]
        doc = ids[mixed][owner[window]]
        low = np.full(equal[-1] + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, equal, doc)
        hit = window[doc > low[equal]]
        r = mixed[owner[hit]]
        out.append((home[r], row[r], (lo[r] + within[hit]).astype(np.uint32), np.ones(len(hit), np.uint8)))
    home, row, lo, n = map(np.concatenate, zip(*out))
    order = np.lexsort((lo, row, home))
    home, row, lo, n = home[order], row[order], lo[order], n[order]
    return _frame([(b, _pack(row[r], lo[r], n[r])) for b, r in _by(home)], ["bin", "load"])


def _cut(with_bytes: bool):
    """What is left of a bin's documents; without the bytes, only of those that lose some."""

    def run(key, left, right):
        left = _members(left, right)
        told = [_unpack(x) for x in right["load"].dropna()]
        row, lo, n = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in told)]).astype(np.int64) for k in range(3))
        order = np.argsort(row, kind="stable")
        row, lo, n = row[order], lo[order], n[order]
        out = []
        for k, (doc_id, tag, raw) in enumerate(zip(left["doc_id"], left["tag"], left["raw"])):
            a, z = np.searchsorted(row, [k, k + 1])
            if a == z and not with_bytes:
                continue
            step = np.zeros(len(raw) + 1, np.int64)
            np.add.at(step, lo[a:z], 1)
            np.add.at(step, lo[a:z] + n[a:z] + DEPTH - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((doc_id, tag, len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        return _frame(out, ["doc_id", "tag", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False, group_bytes: int = 4 << 20, most: int = 4_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept (the bytes left) of every document.

    group_bytes is the text in one group of documents on average; most, the hashes that a task holds at once.
    """
    n = partitions(docs.sparkSession)
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw"))
    rows = rows.withColumn("tag", F.xxhash64("raw"))
    light = rows.select("doc_id", "tag", F.sha2("raw", 256).alias("same"), F.octet_length("raw").cast("long").alias("n_bytes"))
    light = materialize(light, "texts")
    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    groups = max(64, -(-total // group_bytes))
    home = F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("bin")
    twins = light.where(f"doc_id is not null and n_bytes >= {DEPTH}").groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # As a table, so that the join of its two shuffled sides can be split at a text of many copies.
    twins = materialize(twins.where("first < last").select("same", "first"), "twins")
    light = light.join(twins, "same", "left")
    light = light.withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = light.where("copy").select(home, F.lit(None).cast("binary").alias("load"), "doc_id", "tag").distinct()
    dealt = rows.where(f"doc_id is not null and octet_length(raw) >= {DEPTH}").select(home, "doc_id", "tag", "raw").repartition(n, "bin")

    def per_bin(told: DataFrame):
        to_one = told.select("bin", "load", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tag"))
        return dealt.groupBy("bin").cogroup(to_one.union(copies).groupBy("bin"))

    found = dealt.mapInPandas(_scan(groups, most), "target int, load binary")
    shared = found.groupBy("target").applyInPandas(_match, "bin int, load binary")
    around = per_bin(shared).applyInPandas(_surround(groups), "target int, load binary")
    repeats = around.groupBy("target").applyInPandas(_settle, "bin int, load binary")
    left = per_bin(repeats).applyInPandas(
        _cut(with_bytes), "doc_id long, tag long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    out = light.join(left, ["doc_id", "tag"], "left")
    either = lambda copy, cut, whole: F.when(F.col("copy"), copy).otherwise(F.coalesce(cut, whole))
    columns = [
        "doc_id",
        "n_bytes",
        either(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        either(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        either(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.col("same")).alias("kept_sha256"),
    ]
    if not with_bytes:
        return out.select(*columns)
    whole = rows.where(f"doc_id is null or octet_length(raw) < {DEPTH}")
    whole = whole.select("tag", F.col("raw").alias("whole")).distinct()
    return out.join(whole, "tag", "left").select(*columns, either(F.lit(b""), F.col("kept"), F.col("whole")).alias("kept"))
