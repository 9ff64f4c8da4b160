"""Byte-level BPE by a depth-first walk over the trie of distinct words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import kept

#: Fixed value: how byte-level BPE files cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KNOWN = 150_000  # pieces whose ids a task keeps for later batches
PAIRS = 200_000  # pairs of tokens of which a task knows whether they stay apart
SLICE = 1_000_000  # bytes of text that a task encodes at once

_CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_chars() -> dict[str, int]:
    """The printable character that the vocabulary file writes for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder of distinct words that shares the work of shared prefixes.

    A word's encoding is the encoding of a shorter prefix plus one last token. For each prefix, the last token is
    the one vocabulary entry that ends there and that merging leaves next to the last token of what precedes it.
    Sorted distinct words are a trie read depth first: the walk keeps the last token of each prefix on the current
    path, and goes back to the length shared with the next word.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        to_bytes = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes = {i: b for b, i in self.id.items()} | {i: t.encode() for t, i in self.special.items()}
        self.longest = max(map(len, self.id))
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.id[a + b]
            self.merge[self.id[a], self.id[b]] = rank, made
        # an entry that merging its own bytes can't give is never the last token
        self.reachable = {b: i for b, i in self.id.items() if self._merged(b) == [i]}
        self.apart: dict[int, bool] = {}
        self.span = max(self.bytes) + 1

    def _merged(self, raw: bytes) -> list[int]:
        """Plain merging, lowest rank first and leftmost among equals."""
        ids = [self.id[raw[i : i + 1]] for i in range(len(raw))]
        while len(ids) > 1:
            best = min(((self.merge[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.merge[ids[k], ids[k + 1]][1]]
        return ids

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b again."""
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        known = self.apart[a * self.span + b] = self._merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        ids, longest, apart, span = self.reachable, self.longest, self.apart, self.span
        last: list[tuple[int, int]] = [(-1, 0)]  # for each prefix length: its last token and that token's length
        before = b""
        for word in sorted(words):
            n = len(word)
            same = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(len(last), n + 1):
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    token = ids.get(word[start:end])
                    if token is None:
                        continue
                    if start:
                        a = last[start][0]
                        known = apart.get(a * span + token)
                        if not (self._stay_apart(a, token) if known is None else known):
                            continue
                    last.append((token, end - start))
                    break
            out, at = [], n
            while at:
                token, size = last[at]
                out.append(token)
                at -= size
            out.reverse()
            before = word
            yield word, out


class Encoder:
    """Whole texts, with the ids of frequent pieces kept between batches.

    Pieces are kept in two generations of at most KNOWN / 2 each: what is met again moves to the younger one, and when that
    is full the older one goes. A piece that is one word stands for that word, too: cut on its own, a word stays whole.
    """

    def __init__(self, path: str):
        self.bpe = PrefixBpe(path)
        self.marks: dict[bytes | str, bytes] = {m: np.array([i], "<u4").tobytes() for m, i in self.bpe.special.items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.pattern = regex.compile(PATTERN)
        self.stop = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None

    def _pieces(self, text: str) -> list[bytes]:
        """The text cut where no word goes across; each piece is cut further on its own."""
        if _WIDE_SPACE.search(text):
            return [w.encode() for w in self.pattern.findall(text)]
        return _CHUNK.findall(text.encode())

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text, its ids as little-endian unsigned 32-bit integers."""
        parts, new = [], set()
        for text in texts:
            if self.stop and self.stop.search(text):
                pieces: list = []
                for k, run in enumerate(self.stop.split(text)):
                    pieces += [run] if k % 2 else self._pieces(run)
            else:
                pieces = self._pieces(text)
            parts.append(pieces)
            new.update(pieces)
        new -= self.marks.keys()
        found = self._ids(new)
        get = (found | self.marks).__getitem__
        out = [b"".join(map(get, ps)) for ps in parts]
        self._keep(found)
        return out

    def _ids(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces."""
        young, old = self.young, self.old
        found, cuts, words = {}, {}, set()
        for p in pieces:
            ids = young.get(p) or old.get(p)
            if ids is not None:
                found[p] = ids
                continue
            cut = [w.encode() for w in self.pattern.findall(p.decode())]
            if len(cut) > 1:
                cuts[p] = cut
            words.update(cut)
        for w in words:
            ids = young.get(w) or old.get(w)
            if ids is not None:
                found[w] = ids
        for w, ids in self.bpe.encode_words(words - found.keys()):
            found[w] = np.array(ids, "<u4").tobytes()
        for p, cut in cuts.items():
            found[p] = b"".join([found[w] for w in cut])
        return found

    def _keep(self, found: dict[bytes, bytes]) -> None:
        """Adds what a batch has met, as far as there is room."""
        half = KNOWN // 2
        if len(self.young) + len(found) > half:
            self.old, self.young = self.young, {}
        self.young |= found if len(found) <= half else dict(islice(found.items(), half))

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        table = self.bpe.bytes
        return [b"".join([table[i] for i in np.frombuffer(x, "<u4").tolist()]).decode("utf-8", "replace") for x in ids]


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return kept(f"bpe {path}", lambda: Encoder(path))


def in_slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose last column, a text, has about so many bytes; one text stays whole."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0).to_numpy().astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + size)))
            yield b.slice(start, end - start)
            start = end


def encode_documents(docs: DataFrame, tokenizer: str, decode: bool = False) -> DataFrame:
    """docs with a column ids (binary, little-endian unsigned 32-bit integers) in the place of text.

    With decode, also decoded (string), the text that the ids stand for. tokenizer: path of a byte-level BPE file,
    the same on all executors. Null text counts as empty: no ids. Long texts are never cut; repeated rows are
    encoded each; other columns pass through, except ones named ids or decoded, which give way.
    """
    rest = [c for c in docs.columns if c not in ("text", "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in in_slices(batches):
            ids = enc.encode_batch([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            cols = [*b.columns[:-1], pa.array(ids, pa.binary())]
            if decode:
                cols.append(pa.array(enc.decode_batch(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = docs.select(*rest).schema.add("ids", "binary")
    if decode:
        schema = schema.add("decoded", "string")
    names = schema.fieldNames()
    return docs.select(*rest, F.col("text")).mapInArrow(run, schema)
