"""Token ids of a corpus in binary files with Elias-Fano document boundaries."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillway.llm.bpe import in_slices
from rillway.llm.common import cut, kept, scratch

MAGIC = b"EFIDS\x01"
SAMPLE = 128  # a select sample for so many values
FILE_IDS = 4_000_000  # a file is closed once it holds so many ids
BATCH_DOCS, SLICE = 1000, 1_000_000  # documents that a task is handed at once, and bytes of text that it encodes at once

_HEAD = struct.Struct("<6sBBQQQq")  # magic, id width, flags, documents, null doc_ids, ids, first doc_id
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]{1,99}$"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: place of each set bit of a byte
_SET_BIT = np.array([([b for b in range(8) if i >> b & 1] + [0] * 8)[:8] for i in range(256)], np.int64)


class EliasFano:
    """A non-decreasing list of n integers below u in about n * (2 + log2(u / n)) bits.

    Low bits are packed; high parts are unary, one bit set for each value. The place of each SAMPLE-th set bit is kept
    in 32 bits, so reading one value looks at a few bytes.
    """

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u4")

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)).astype(np.uint8) & 1
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, bits, pack(low.ravel()), pack(high), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # set bits still to pass, the one at place not counted
        byte, first = place >> 3, int(self.high[place >> 3]) & (0xFF << (place & 7))
        count = int(_ONES[first])
        while count <= left:
            left -= count
            byte += 1
            first = int(self.high[byte])
            count = int(_ONES[first])
        for bit in range(8):
            if first >> bit & 1:
                if not left:
                    break
                left -= 1
        high = byte * 8 + bit - i
        at, low = i * self.low_bits, 0
        for k in range(self.low_bits):
            low |= (int(self.low[at + k >> 3]) >> (at + k & 7) & 1) << k
        return high << self.low_bits | low

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The values at many places: the samples say where to start, counts of set bits by byte lead to the byte, a table into it."""
        if not len(i):
            return np.zeros(0, np.uint64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError(int(i.max()))
        start = self.samples[i // SAMPLE].astype(np.int64) >> 3
        upto = np.concatenate([[0], np.cumsum(_ONES[self.high], dtype=np.int64)])
        # the byte with the (i + 1)-th set bit lies at or behind the sample's
        byte = np.maximum(start, np.searchsorted(upto, i, side="right") - 1)
        high = byte * 8 + _SET_BIT[self.high[byte], i - upto[byte]] - i
        out = high.astype(np.uint64) << np.uint64(self.low_bits)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        for k in range(self.low_bits):
            out |= bits[:, k].astype(np.uint64) << np.uint64(k)
        return out

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return struct.pack("<QBQQQ", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def read(cls, raw: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = struct.unpack_from("<QBQQQ", raw, at)
        at += struct.calcsize("<QBQQQ")
        parts = []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size
        return cls(n, bits, *parts), at


def pack_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A file: head, Elias-Fano doc_ids, Elias-Fano ends of the documents, then all ids in 2 or 4 bytes each.

    doc_ids ascend, null ones first; ids are little-endian unsigned 32-bit integers.
    """
    real = np.array([d for d in doc_ids if d is not None], np.int64)
    joined = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(joined) or joined.max() < 1 << 16 else 4
    first = int(real[0]) if len(real) else 0
    ends = np.cumsum([len(x) // 4 for x in ids])
    head = _HEAD.pack(MAGIC, width, 0, len(ids), len(ids) - len(real), len(joined), first)
    return head + EliasFano.build(real - first).to_bytes() + EliasFano.build(ends).to_bytes() + joined.astype(f"<u{width}").tobytes()


class TokenFile:
    """A file read back."""

    def __init__(self, raw: bytes):
        magic, width, _, self.n, self.nulls, n_ids, self.first = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.names, at = EliasFano.read(raw, _HEAD.size)
        self.ends, at = EliasFano.read(raw, at)
        self.ids = np.frombuffer(raw, f"<u{width}", n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all().astype(np.int64) + self.first).tolist()

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, from two reads of the boundaries."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class WordTokenizer:
    """The tokenizers library on distinct words; ids of frequent words are kept between batches.

    The file's own rules lower-case texts, split them at white space and between letters and punctuation, and never join
    across: so a text's ids are the ids of its parts, one after the other. A batch's words are dictionary-coded and
    words of letters are parted from the marks behind them; what is kept for a part is a place in one array of ids, so
    texts are put together by array gathers. known bounds the parts kept: beyond it, the half met less often goes.
    """

    def __init__(self, path: str, known: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        # ids that end a word; words of letters can then be encoded in one call, joined by spaces, and told apart
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        #: found in texts as they are, before they are lower-cased
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.known = known
        self._keep({"": 0}, np.zeros(0, "<u4"), np.zeros(1, np.int64), np.ones(1, np.int64))

    def _keep(self, slots: dict[str, int], flat: np.ndarray, sizes: np.ndarray, met: np.ndarray) -> None:
        self.slots, self.flat, self.sizes, self.met = slots, flat, sizes, met
        self.starts = np.cumsum(sizes) - sizes

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of many words of letters from one call, and how many each has; None if they can't be told apart."""
        ids = np.array(self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(at, prepend=0)) if len(at) == len(words) and at[-1] == len(ids) else None

    def _learn(self, new: list[str]) -> None:
        """Gives each part a slot."""
        plain = [s for s in new if s.isalpha() and len(s) < 100 and (s.isascii() or _PLAIN.fullmatch(s))]
        rest = list(set(new) - set(plain))
        order, flat, sizes = [], [self.flat], [self.sizes]
        for k in range(0, len(plain), 1000):
            got = self._encode_plain(plain[k : k + 1000])
            if got:
                order += plain[k : k + 1000]
                flat.append(got[0])
                sizes.append(got[1])
            else:
                rest += plain[k : k + 1000]
        order += rest
        one_by_one = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
        flat.append(np.array(list(chain.from_iterable(one_by_one)), "<u4"))
        sizes.append(np.array([len(x) for x in one_by_one], np.int64))
        first = len(self.sizes)
        self.slots.update(zip(order, range(first, first + len(order))))
        self._keep(self.slots, np.concatenate(flat), np.concatenate(sizes), np.concatenate([self.met, np.zeros(len(order), np.int64)]))

    def _forget(self) -> None:
        self.met[0] = 1 << 40  # the empty part stays
        keep = np.sort(np.argsort(self.met, kind="stable")[len(self.met) // 2 :])
        place = np.full(len(self.met), -1)
        place[keep] = np.arange(len(keep))
        slots = {w: p for w, p in zip(self.slots, place.tolist()) if p >= 0}  # slots are given in the order of the dict
        self._keep(slots, self.flat[_spans(self.starts[keep], self.sizes[keep])], self.sizes[keep], self.met[keep] // 2)

    def _slots(self, parts: pa.Array) -> np.ndarray:
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        new = [w for w in names if w not in self.slots]
        if new:
            self._learn(new)
        index = coded.indices.to_numpy()
        slot = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))
        self.met[slot] += np.bincount(index, minlength=len(names))
        return slot[index]

    def encode_batch(self, texts: list[str], end: int) -> list[bytes]:
        if len(self.slots) > self.known:
            self._forget()
        given = pa.array(texts, pa.large_string())
        lower = pc.ascii_lower(given)
        last = struct.pack("<I", end)
        # where lower-casing makes or hides an added token, the text's parts are not what the library sees
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= np.asarray(pc.not_equal(pc.count_substring(lower, token), pc.count_substring(given, token)))
        whole = {i: np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes() + last for i in np.flatnonzero(odd).tolist()}
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", lower))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        # marks behind a word of letters are a part of their own
        core = pc.utf8_rtrim(words, ".,;:!?")
        parted = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(words)), pc.match_substring_regex(core, _LETTERS))
        tails = pc.if_else(parted, pc.replace_substring_regex(words, r"^[^.,;:!?]+", ""), "")
        parts = self._slots(pa.concat_arrays([pc.if_else(parted, core, words), tails]))
        each = parts.reshape(2, len(words)).T[coded.indices.to_numpy()].ravel()
        sizes = self.sizes[each]
        ids = self.flat[_spans(self.starts[each], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[2 * lists.offsets.to_numpy()].tolist()
        return [whole[i] if i in whole else ids[a:b].tobytes() + last for i, (a, b) in enumerate(zip(upto, upto[1:]))]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def write_store(docs: DataFrame, tokenizer: str, path: str, end: int) -> DataFrame:
    """Encode docs and write token files under path, a folder that all executors share.

    Documents are dealt by ranges of doc_id and sorted; each task writes the files of its range as it reads, in
    FILE_IDS ids each, so no task holds more than one file. A file gets its name only when it is whole, and a task that
    runs again writes the same files again. Null texts are empty, null doc_ids come first, equal doc_ids are ordered by
    text, an empty table gives no file.

    Returns file, start (ids in all files before it), n_docs, n_ids.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept(f"words {tokenizer}", lambda: WordTokenizer(tokenizer))
        fs, folder = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        fs.create_dir(folder, recursive=True)
        part, number, names, ids, held, rows = TaskContext.get().partitionId(), 0, [], [], 0, []

        def close() -> None:
            nonlocal number, names, ids, held
            file = f"{part:08d}-{number:06d}.efids"
            # each attempt writes under a name of its own, then takes the final one
            draft = f"{folder}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as f:
                f.write(pack_file(names, ids))
            fs.move(draft, f"{folder}/{file}")
            rows.append((file, part, number, len(ids), held))
            number, names, ids, held = number + 1, [], [], 0

        for b in in_slices(batches, SLICE):
            names += b.column(0).to_pylist()
            new = words.encode_batch([t or "" for t in b.column(1).to_pylist()], end)
            ids += new
            held += sum(map(len, new)) // 4
            if held >= FILE_IDS:
                close()
        if names:
            close()
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "part", "number", "n_docs", "n_ids"])

    dealt = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    conf, setting = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(setting)
    conf.set(setting, str(BATCH_DOCS))
    try:
        files = cut(dealt.mapInArrow(write, "file string, part int, number int, n_docs bigint, n_ids bigint"), "token-files")
    finally:
        conf.set(setting, before)
    # running sums in two steps, so that no task sees the files of all parts
    groups = files.groupBy((F.col("part") / 1024).cast("int").alias("grp")).agg(F.sum("n_ids").alias("ids"))
    before = groups.select("grp", (F.sum("ids").over(Window.orderBy("grp")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("grp").orderBy("part", "number")) - F.col("n_ids")
    return files.withColumn("grp", (F.col("part") / 1024).cast("int")).withColumn("inside", inside).join(before, "grp").select("file", (F.col("before") + F.col("inside")).alias("start"), "n_docs", "n_ids")


def read_store(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, ids_crc32 (of the ids in 32 bits each)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                f = TokenFile(raw.as_py())
                ends = f.ends.select_many(np.arange(f.n)).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                wide = f.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:e]) for a, e in zip(starts, ends)]
                file = name.rsplit("/", 1)[-1]
                cols = [pa.array([file] * f.n), pa.array(f.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["file", "doc_id", "local", "n_tokens", "ids_crc32"])

    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.efids").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    rows = content.select("path", "content").mapInArrow(read, "file string, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(files.select("file", "start"), "file").select("doc_id", (F.col("start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """Write docs as token files under path (a new shared folder if none is given) and read them back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; texts are taken whole, however long. Rows that share a doc_id, or have none, are documents
    of their own, null doc_ids first; equal rows are stored each. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)  # an empty table leaves it empty
    files = write_store(docs, tokenizer, path, end)
    return read_store(spark, path, files)
