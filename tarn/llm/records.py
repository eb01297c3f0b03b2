"""Token-ID output: length-delimited binary records with masked checksums, and an offset index beside each file.

A record is: payload length (unsigned 64-bit), masked checksum of those 8 bytes (32-bit), payload, masked checksum of
the payload; all little-endian. The payload is the id of the document (signed 64-bit), a flag (1: the id is null), the
bytes of a token id (2 or 4), two zero bytes, and the token ids. A checksum is the CRC-32 of zlib, rotated right by 15
bits plus 0xA282EAD8. The index file has the magic number and each record's offset (unsigned 64-bit), so that a
shuffled reader can seek to any record.

Documents are dealt by ranges of their id, each partition sorted and written as one file, so the files
in order hold all ids ascending. Token positions follow from the files' totals, one row per file.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._cluster import durable, new_dir, ready
from ._files import NewFile, opened
from ._words import Words, steps

MASK = 0xA282EAD8
HEAD = struct.Struct("<QI")
DOC = struct.Struct("<qBBxx")
CHECK = struct.Struct("<I")
INDEX_MAGIC = b"TARNIDX1"
#: Words whose ids a worker remembers; when full it keeps those that it met again.
CACHE_WORDS = 600_000
#: Words of a very long text that are encoded at a time.
ENCODE_WORDS = 1 << 19


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, tokens: np.ndarray, width: int) -> bytes:
    """One record."""
    payload = DOC.pack(doc_id or 0, doc_id is None, width) + tokens.astype("<u2" if width == 2 else "<u4").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + CHECK.pack(masked(length)) + payload + CHECK.pack(masked(payload))


class Encoder:
    """Token ids of texts. by_word: encode white-space-separated words one by one and remember them by their 64-bit hash.

    That gives the same ids for tokenizers that drop white space and never join across it. A remembered word takes some 40 bytes.
    """

    def __init__(self, path: str, by_word: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:  # ids that end a run of letters or of other marks
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.keys, self.hits = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens

    def _plain_ids(self, words: list[str], runs: np.ndarray, each: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of a known number of runs, encoded some hundred to a text, which is twice as fast."""
        flat, lens = [], []
        for at in range(0, len(words), each):
            own, expected = words[at : at + each], runs[at : at + each]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == expected.sum() and (not len(ids) or stops[-1] == len(ids)):
                lens.append(np.diff(np.r_[0, stops[np.cumsum(expected) - 1]]))
            else:
                ids, count = self._ids(own)
                lens.append(count)
            flat.append(ids)
        return (np.concatenate(flat), np.concatenate(lens)) if flat else (self.flat[:0], self.lens[:0])

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        runs = np.fromiter((1 if t.isalpha() else 2 if t[-1] in ",.;:!?" and t[:-1].isalpha() else 0 for t in texts), np.int64, len(texts))
        if self.ends is None:
            runs[:] = 0
        order = np.argsort(runs == 0, kind="stable")
        texts, plain = [texts[k] for k in order], int((runs > 0).sum())
        one, two = self._plain_ids(texts[:plain], runs[order][:plain]), self._ids(texts[plain:])
        lens = np.concatenate([one[1], two[1]])
        starts = len(self.flat) + np.cumsum(lens) - lens
        self.flat = np.concatenate([self.flat, one[0], two[0]])
        every = np.concatenate([self.keys, keys[order]])
        place = np.argsort(every, kind="stable")
        self.keys = every[place]
        self.starts, self.lens = np.concatenate([self.starts, starts])[place], np.concatenate([self.lens, lens])[place]
        self.hits = np.concatenate([self.hits, np.zeros(len(keys), np.int32)])[place]

    def _forget(self) -> None:
        """Keeps the words that were met again, unless those are too many as well."""
        least = 2
        while (kept := self.hits >= least).sum() > CACHE_WORDS // 2:
            least *= 2
        lens = self.lens[kept]
        self.flat = _gather(self.flat, self.starts[kept], lens)
        self.keys, self.starts, self.lens, self.hits = self.keys[kept], np.cumsum(lens) - lens, lens, np.ones(len(lens), np.int32)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys stand, and which are absent."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, np.flatnonzero(self.keys[at] != keys)

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text, as unsigned 32-bit numbers."""
        if not self.by_word:
            for text in column.to_pylist():
                yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)
            return
        for _, _, words in steps(column, lower=False):
            n = len(words.hashes)
            if len(words) == 1 and n > ENCODE_WORDS:  # a very long text
                yield np.concatenate([self._words_ids(words, a, min(n, a + ENCODE_WORDS))[0] for a in range(0, n, ENCODE_WORDS)])
                continue
            ids, lens = self._words_ids(words, 0, n)
            bounds = np.r_[0, np.cumsum(lens)][words.first].tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield ids[a:b]

    def _words_ids(self, words: Words, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words a to b, and how many each has."""
        keys, first, which = np.unique(words.hashes[a:b], return_index=True, return_inverse=True)
        at, absent = self._places(keys)
        if len(self.keys) + len(absent) > CACHE_WORDS:
            self._forget()
            at, absent = self._places(keys)
        if len(absent):
            spots = first[absent] + a
            self._learn(keys[absent], [words.data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(words.starts[spots].tolist(), words.ends[spots].tolist(), strict=True)])
            at, absent = self._places(keys)
        self.hits[at] += 1
        lens = self.lens[at][which]
        return _gather(self.flat, self.starts[at][which], lens), lens


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + len], one after the other."""
    ends = np.cumsum(lens)
    n = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + lens, lens) + np.arange(n)]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def _write(folder: str, path: str, end: int | None, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        file, offsets, n_docs, n_tokens = None, [], 0, 0
        encode = encoder(path, by_word)
        width = 2 if max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end or 0) <= 1 << 16 else 4
        for batch in batches:
            for own, tokens in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text")), strict=True):
                file = file or NewFile(f"{folder}/part-{part:06d}.rec")
                if end is not None:
                    tokens = np.append(tokens, np.uint32(end))
                offsets.append(file.size)
                file.write(frame(own, tokens, width))
                n_docs, n_tokens = n_docs + 1, n_tokens + len(tokens)
        if file:
            file.close()
            index = NewFile(f"{folder}/part-{part:06d}.idx")
            index.write(INDEX_MAGIC + np.array(offsets, "<u8").tobytes())
            index.close()
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([f"{folder}/part-{part:06d}.rec"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return run


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", by_word: bool = True) -> DataFrame:
    """Writes all docs in ascending id order; returns a row per file: part, path, n_docs, n_tokens.

    Null ids come first; rows of equal id are ordered by a hash of the text. Null texts are empty and have the end id alone. An empty
    table writes no file. Texts are encoded whole; other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    folder = folder or new_dir(spark, "records")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return durable(rows.mapInArrow(_write(folder, tokenizer, end, by_word), "part long, path string, n_docs long, n_tokens long"))


class CorruptRecord(ValueError):
    """A length or a payload does not have its checksum."""


def iterate_records(uri: str, buffer: int = 1 << 23) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, token ids) of one file in order, checksums verified."""
    system, path = opened(uri)
    with system.open_input_stream(path, compression=None, buffer_size=buffer) as stream:
        while head := stream.read(HEAD.size):
            if len(head) < HEAD.size:
                raise CorruptRecord(f"{uri}: cut off in a length")
            length, check = HEAD.unpack(head)
            if masked(head[:8]) != check:
                raise CorruptRecord(f"{uri}: length checksum")
            yield _parse(uri, stream.read(length), stream.read(CHECK.size))


def _parse(uri: str, payload: bytes, check: bytes) -> tuple[int | None, np.ndarray]:
    if len(check) < CHECK.size or CHECK.unpack(check)[0] != masked(payload):
        raise CorruptRecord(f"{uri}: payload checksum")
    own, null, width = DOC.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=DOC.size)
    return None if null else own, ids.astype("<u4")


def read_index(uri: str) -> np.ndarray:
    """Offsets of a file's records, from the index beside it."""
    system, path = opened(uri.removesuffix(".rec") + ".idx")
    with system.open_input_stream(path, compression=None) as stream:
        data = stream.read()
    if data[:8] != INDEX_MAGIC:
        raise CorruptRecord(f"{uri}: no index")
    return np.frombuffer(data, "<u8", offset=8)


def read_at(uri: str, offsets: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records at the given offsets, in the order given."""
    system, path = opened(uri)
    with system.open_input_file(path) as file:
        for at in offsets:
            file.seek(int(at))
            head = file.read(HEAD.size)
            length, check = HEAD.unpack(head)
            if masked(head[:8]) != check:
                raise CorruptRecord(f"{uri}: length checksum")
            yield _parse(uri, file.read(length), file.read(CHECK.size))


def read_records(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per record of the files: doc_id, start, n_tokens, ids_crc32 (and ids); start counts token ids of all records before."""
    ready(files.sparkSession)
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("base"), "part")
    n = max(1, files.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows: list[tuple] = []
                for own, ids in iterate_records(uri):
                    rows.append((own, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if with_ids else [])))
                    start += len(ids)
                    if len(rows) == (200 if with_ids else 4000):
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return placed.repartition(n, "part").select("path", "base").mapInArrow(run, schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
