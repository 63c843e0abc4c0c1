"""BPE encoding by forced-boundary splitting, and decoding.

A pair of adjacent bytes that occurs inside no token of the vocabulary can't be joined by any merge, so a text may
be cut there for certain. That is done twice. First, a text is cut at the forced boundaries between a byte that isn't
white space and ASCII white space; these leave the pre-tokenizer's pieces as they are, since every alternative of its
pattern takes white space only at its front. The fragments are encoded once per worker while they stay in a memo of
bounded bytes. A fragment that isn't in it is cut into the pre-tokenizer's pieces and at all forced boundaries inside
these, and each of the small fragments is merged by itself, also once while it is in a memo; ids are concatenated.
Fragments of characters on whose kind libraries may differ go to the tokenizer library as they are. Added tokens found
in a text, such as an end-of-text mark, are split off first and stand for themselves.

Defined results: a null or empty text has no ids and decodes to "". Rows are independent: repeated rows
give repeated results, an empty table an empty one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import regex

SPACES = b" \t\n\v\f\r"
#: White space beyond ASCII, and the separators 28 to 31, which libraries treat differently.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  ⁠　﻿]")

#: The byte-level pre-tokenizer's pattern, a fixed value of the format.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What a memo's entry takes beside its bytes, about.
_EACH = 200
#: Stands for ids still to come; those take four bytes each.
_OPEN = b"?"
#: Bytes of anything but ASCII without the separators 28 to 31, and characters from U+00C0 to U+023F.
_UNCOMMON = re.compile(rb"[\x1c-\x1f\xc0-\xc2\xc9-\xff]").search


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The byte for which each character stands in a byte-level vocabulary: printable Latin-1 for itself, the
    rest from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids of fragments. Asked for one that isn't in it, it notes that and gives _OPEN."""

    def __init__(self):
        self.asked: list[bytes] = []

    def __missing__(self, fragment: bytes) -> bytes:
        self.asked.append(fragment)
        return _OPEN


class ForcedBoundaryBPE:
    """encode() and decode() of one byte-level vocabulary file; one instance per worker."""

    _loaded: dict[tuple[str, int], ForcedBoundaryBPE] = {}

    def __init__(self, path: str, memo: int = 128 << 20):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        chars = byte_of_char()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = max([*vocab.values(), *added.values()], default=-1) + 1
        self.bytes_of: list[bytes] = [b""] * size
        joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            if token in added:
                continue
            raw = bytes(chars[c] for c in token)
            self.bytes_of[i] = raw
            for a, b in zip(raw, raw[1:]):
                joined[a, b] = True
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.forced = ~joined
        space = np.zeros(256, bool)
        space[list(SPACES)] = True
        self._cut = (self.forced & ~space[:, None] & space[None, :]).ravel()
        self._added = {k: np.uint32(i).tobytes() for k, i in added.items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # Where each (byte, space) of a text is a cut, a pattern finds the fragments faster than an array does.
        uncut = [a for a in range(256) if not space[a] and any(joined[a, b] for b in SPACES)]
        self._uncut = re.compile(b"[" + re.escape(bytes(uncut)) + b"][ \\t-\\r]") if uncut else None
        self._merge = self._by_rank(spec, added)
        self._pieces = regex.compile(PIECES)
        self._forced = self.forced.ravel()
        #: Ids of fragments, and of the small fragments inside them. `memo` bounds the bytes of each, about.
        self._memo = _Memo()
        self._small: dict[bytes, bytes] = {}
        self._held, self._held_small, self._most = 0, 0, memo

    def _by_rank(self, spec: dict, added: dict):
        """A merger of bytes by token rank, if the vocabulary numbers its tokens in the order of its merges; else none."""
        merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"].get(m.replace(" ", ""), -1) for m in merges]
        first = ids[0] if ids else 0
        if ids != list(range(first, first + len(ids))) or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            return None
        import tiktoken

        ranks = {self.bytes_of[i]: i for t, i in spec["model"]["vocab"].items() if t not in added}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    @classmethod
    def load(cls, path: str, memo: int = 128 << 20) -> ForcedBoundaryBPE:
        key = (path, memo)
        if key not in cls._loaded:
            cls._loaded[key] = cls(path, memo)
        return cls._loaded[key]

    def fragments(self, text: str) -> list[bytes]:
        """text's UTF-8 cut at forced boundaries; joined, they give it back."""
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            return []
        wide = WIDE_SPACE.search(text) is not None
        if not wide and not (self._uncut and self._uncut.search(raw)):
            return _FRAGMENT.findall(raw)
        b = np.frombuffer(raw, np.uint8)
        cut = self._cut[b[:-1].astype(np.int32) * 256 + b[1:]]
        if wide:  # what follows a wide space may belong to the same piece
            cut &= (b[:-1] > 32) & (b[:-1] < 127)
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def _learn(self, missing: list[bytes]) -> None:
        """Put the ids of these fragments into the memo, as little-endian unsigned 32-bit integers."""
        memo = self._memo
        self._held += sum(map(len, missing)) + _EACH * len(missing)
        rest = missing
        if self._merge:
            common = [f for f in missing if f[0] < 33 and f[-1] > 32]  # led by white space, but not ending in it
            if _UNCOMMON(b"".join(common)):
                common = [f for f in common if not _UNCOMMON(f)]
            for lo in range(0, len(common), 50_000):
                self._encode_common(common[lo : lo + 50_000])
            rest = [f for f in missing if f not in memo]
        for lo in range(0, len(rest), 50_000):
            part = rest[lo : lo + 50_000]
            for f, e in zip(part, self._library.encode_batch_fast([f.decode() for f in part], add_special_tokens=False)):
                memo[f] = np.array(e.ids, "<u4").tobytes()

    def small_fragments(self, raw: bytes) -> tuple[list[bytes], np.ndarray]:
        """raw cut into the pre-tokenizer's pieces and at every forced boundary inside them, and where they end."""
        text = raw.decode()
        pieces = self._pieces.findall(text)
        if len(text) < len(raw):
            pieces = map(str.encode, pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64))
        b = np.frombuffer(raw, np.uint8)
        cut = self._forced[b[:-1].astype(np.int32) * 256 + b[1:]]
        cut = np.append(cut, True)
        cut[ends - 1] = True
        ends = np.flatnonzero(cut) + 1
        at = ends.tolist()
        return [raw[a:z] for a, z in zip([0, *at], at)], ends

    def _encode_common(self, fragments: list[bytes]) -> None:
        """Memoize fragments of characters on which all libraries agree. Each begins with white space and ends without,
        so that their seams are forced boundaries too, and all can be cut together."""
        parts, ends = self.small_fragments(b"".join(fragments))
        small = self._small
        if self._held_small > self._most:
            small.clear()
            self._held_small = 0
        new = list(set(parts).difference(small))
        self._held_small += sum(map(len, new)) + _EACH * len(new)
        merged = list(map(self._merge, new))
        ids = np.fromiter(chain.from_iterable(merged), "<u4").tobytes()
        upto = (4 * np.cumsum(np.fromiter(map(len, merged), np.int64, len(merged)))).tolist()
        small.update(zip(new, [ids[a:z] for a, z in zip([0, *upto], upto)]))
        found = list(map(small.__getitem__, parts))
        ids = b"".join(found)
        upto = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        last = upto[np.searchsorted(ends, np.cumsum(np.fromiter(map(len, fragments), np.int64, len(fragments))))].tolist()
        self._memo.update(zip(fragments, [ids[a:z] for a, z in zip([0, *last], last)]))

    def encode(self, text: str | None) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode() of each; new fragments of all of them are encoded together."""
        memo, out, todo = self._memo, [], []
        if self._held > self._most:
            memo.clear()
            self._held = 0
        memo.asked = asked = []
        known = memo.__getitem__
        for text in texts:
            before = len(asked)
            if text and self._split and self._split.search(text):
                found = []
                for i, p in enumerate(self._split.split(text)):
                    found += [self._added[p]] if i % 2 else map(known, self.fragments(p))
            else:
                found = list(map(known, self.fragments(text or "")))
            if len(asked) > before:
                todo.append((len(out), found, before, len(asked)))
                out.append(b"")
            else:
                out.append(b"".join(found))
        self._learn(list(set(asked)))
        for k, found, a, z in todo:
            at = -1
            for fragment in asked[a:z]:
                at = found.index(_OPEN, at + 1)
                found[at] = memo[fragment]
            out[k] = b"".join(found)
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_FRAGMENT = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def slices(batch, at: int, rows: int = 512, size: int = 8 << 20):
    """batch in slices of some rows whose texts (column `at`) take about `size` bytes at most, or one row."""
    import pyarrow.compute as pc

    taken = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = taken[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(taken, before + size, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def one_thread() -> None:
    """Let the tokenizer library use the task's own core only."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def encoded(docs, vocabulary: str, column: str = "text", ids: str = "ids", decoded: str | None = None):
    """docs with the ids of `column` (binary, little-endian unsigned 32-bit) and, if asked, their decoded text."""
    from pyspark.sql import types as T

    taken = {c.lower() for c in docs.columns}
    for name in filter(None, (ids, decoded)):
        if name.lower() in taken:
            raise ValueError(f"{name} is a column already; give another name")
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(ids, T.BinaryType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator):
        import pyarrow as pa

        one_thread()
        bpe = ForcedBoundaryBPE.load(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for part in slices(batch, at):
                found = bpe.encode_all(part.column(at).to_pylist())
                columns = [*part.columns, pa.array(found, pa.binary())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def token_report(docs, vocabulary: str | None = None):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    from pyspark.sql import functions as F

    out = encoded(docs.select("doc_id", "text"), vocabulary or default_vocabulary(), decoded="decoded")
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
