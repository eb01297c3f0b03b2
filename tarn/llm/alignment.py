"""Cross-tokenizer alignment: tokens of two vocabularies whose byte ranges end together, counted in id-striped dense matrices.

Encoding. A space and the text are encoded by both tokenizers, some megabyte of texts at a time; token ends are sums of byte lengths, so all texts of a step are
aligned by a few array operations. Where both tokens end, a group of tokens ends; the two tokens that end there are linked. A longer text is cut
between a character that is no white space and a space: the byte-level pattern splits there, and no piece holds a space after another character
(`_Pair` checks that; else such texts stay whole).

Counting. A task deals the links of some million tokens, a portion, by stripes of ids of side b (id modulo the number of stripes). A stripe's
part of the count matrix is a dense block, a row for each of its b ids and a column for each a id; `np.add.at` adds the portions' links, and row
maxima give each b id's best count. Stripes with many links are dealt out in parts of bounded size, whose blocks are then added a few at a time.

Scoring. The links lie by the same stripe and part, each with its whole stripe's counts; what a stripe finds for a document is added by portion.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cluster import new_dir, ready, trim

#: Characters of text that are encoded at a time.
STEP_CHARS = 1 << 20
#: A portion ends after so many links or documents; the latter are numbered in 16 bits.
PORTION_LINKS, PORTION_DOCS = 1 << 20, 60_000
#: Bits of an a id within a link's code.
A_BITS = 24
EDGE = re.compile(r"(?<=\S) (?=\s*\S)")
#: Runs that rank merging would take long over.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
#: Fixed value: how a byte-level vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

ENCODED = "portion long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, codes binary, totals binary, spread binary, docs binary, times binary"
_held: dict = {}
NONE = np.zeros(0, np.uint64)


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest for 256 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def rank_encoding(path: str):
    """The plain byte-level vocabulary of a `tokenizers` file as ranks of `tiktoken`, which gives the same ids several times faster; None for any other vocabulary.

    That holds where ids follow the merges: then a merge's rank is its id, and both take the merge of lowest rank first.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    letters = byte_letters()
    vocab = {bytes(map(letters.__getitem__, x)): k for x, k in model["vocab"].items() if all(c in letters for c in x) and x not in {t["content"] for t in told.get("added_tokens", ())}}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and told.get("normalizer") is None
    if not plain or any(before.get(k) != v for k, v in usual.items()) or [model["vocab"].get(m) for m in merges] != list(range(256, 256 + len(merges))):
        return None
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})


class _Pair:
    """Two tokenizers, with the bytes, lengths and written ids of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.ranks = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), rank_encoding(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.bytes_a = {k: bytes(map(letters.__getitem__, entry)) for entry, k in self.a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in entry)}
        pieces = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.bytes_b = {k: bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in pieces}
        self.may_cut = not any(re.search(r"\S ", p.replace("▁", " ")) for k, p in pieces if not self.b.is_byte(k))
        self.length_a, self.length_b = (np.array([len(of.get(k, b"")) for k in range(max(of) + 1)]) for of in (self.bytes_a, self.bytes_b))
        written = lambda n, end: np.array([b"%d%s" % (k, end) for k in range(n)], dtype=object)
        self.say_a = [written(len(self.length_a), end) for end in (b",", b"|")]
        self.say_b = [written(len(self.length_b), end) for end in (b",", b";")]

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [x.ids for x in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [self.ranks.encode_ordinary(" " + t) if not LONG_RUN.search(t) else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]

    def aligned(self, texts: list[str]) -> list[tuple[int, int, int, bytes, np.ndarray] | None]:
        """Per text, which is not empty: tokens of a, of b, groups, the groups written with a last semicolon, codes of the links; None where the bytes differ."""
        own_a, own_b = self.encode_a(texts), self.b.encode(texts, num_threads=1)
        wholes = [b" " + t.encode() for t in texts]
        good = [k for k, w in enumerate(wholes) if b"".join(map(self.bytes_a.__getitem__, own_a[k])) == w == b"".join(map(self.bytes_b.__getitem__, own_b[k]))]
        out: list = [None] * len(texts)
        if not good:
            return out
        a, b = (np.concatenate([np.array(own[k], np.int64) for k in good]) for own in (own_a, own_b))
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        meet = np.minimum(np.searchsorted(end_b, end_a), len(b) - 1)
        last_a = np.flatnonzero(end_b[meet] == end_a)
        last_b = meet[last_a]
        codes = b[last_b].astype(np.uint64) << np.uint64(A_BITS) | a[last_a].astype(np.uint64)
        # each group's tokens of a, then those of b
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        said = np.empty(len(a) + len(b), dtype=object)
        place_a, place_b = np.arange(len(a)) + np.r_[0, last_b + 1][group_a], np.arange(len(b)) + (last_a + 1)[group_b]
        said[place_a], said[place_b] = self.say_a[0][a], self.say_b[0][b]
        said[place_a[last_a]], said[place_b[last_b]] = self.say_a[1][a[last_a]], self.say_b[1][b[last_b]]
        tops = np.cumsum([len(wholes[k]) for k in good])
        to_a, to_b, to_group = (np.searchsorted(x, tops, side="right").tolist() for x in (end_a, end_b, end_a[last_a]))
        i = j = g = 0
        for k, x, y, z in zip(good, to_a, to_b, to_group, strict=True):
            out[k] = (x - i, y - j, z - g, b"".join(said[i + j : x + y].tolist()), codes[g:z])
            i, j, g = x, y, z
        return out

    def parts_of(self, text: str) -> Iterator[str]:
        at = 0
        while self.may_cut and len(text) - at > STEP_CHARS and (m := EDGE.search(text, at + STEP_CHARS)):
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def document(self, text: str | None) -> tuple[list, np.ndarray]:
        """([n_a, n_b, n_groups, n_links, groups_sha256], codes); zeros for a text without tokens."""
        counts, codes, digest, held = np.zeros(3, np.int64), [], hashlib.sha256(), b""
        for part in self.parts_of(text) if text else ():
            if (own := self.aligned([part])[0]) is None:
                return [0, 0, 0, 0, ""], NONE
            digest.update(held)
            counts, held = counts + own[:3], own[3]
            codes.append(own[4])
        digest.update(held[:-1])
        return self.told(counts.tolist(), digest, np.concatenate(codes) if codes else NONE)

    @staticmethod
    def told(counts: list[int], digest, codes: np.ndarray) -> tuple[list, np.ndarray]:
        return [*counts, len(codes), digest.hexdigest() if counts[0] else ""], codes

    def documents(self, texts: list[str | None]) -> Iterator[tuple[list, np.ndarray]]:
        """The same of each; some megabyte of texts are encoded and aligned together."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to] or "") <= STEP_CHARS):
                chars += len(texts[to] or "")
                to += 1
            if to == at + 1:
                yield self.document(texts[at])
            else:
                found = iter(self.aligned([t for t in texts[at:to] if t]))
                for t in texts[at:to]:
                    own = next(found) if t else None
                    yield self.told(list(own[:3]), hashlib.sha256(own[3][:-1]), own[4]) if own else ([0, 0, 0, 0, ""], NONE)
            at = to


def _loaded(path_a: str, path_b: str) -> _Pair:
    if (path_a, path_b) not in _held:
        _held[path_a, path_b] = _Pair(path_a, path_b)
    return _held[path_a, path_b]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _links(portion: int, parts: list[np.ndarray], stripes: int) -> pa.RecordBatch | None:
    """A row for each stripe: different codes, how often each is linked, in how many documents, and those documents with their shares."""
    lengths = [len(p) for p in parts]
    if not sum(lengths):
        return None
    codes = np.concatenate(parts)
    keys = codes << np.uint64(16) | np.repeat(np.arange(len(parts), dtype=np.uint64), lengths)
    keys, times = np.unique(keys, return_counts=True)
    codes = keys >> np.uint64(16)
    stripe = (codes >> np.uint64(A_BITS)) % np.uint64(stripes)
    order = np.argsort(stripe, kind="stable")
    keys, codes, times, stripe = keys[order], codes[order], times[order].astype(np.uint32), stripe[order]
    edges = [0, *(np.flatnonzero(np.diff(stripe)) + 1).tolist(), len(stripe)]
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        first = np.flatnonzero(np.r_[True, codes[a + 1 : b] != codes[a : b - 1]])
        totals = np.add.reduceat(times[a:b].astype(np.uint64), first)
        spread = np.diff(np.r_[first, b - a]).astype(np.uint32)
        rows.append({"portion": portion, "stripe": int(stripe[a]), "codes": codes[a:b][first].tobytes(), "totals": totals.tobytes(), "spread": spread.tobytes(), "docs": keys[a:b].astype(np.uint16).tobytes(), "times": times[a:b].tobytes()})
    return pa.RecordBatch.from_pylist(rows, _schema(ENCODED))


def _encode(path_a: str, path_b: str, stripes: int):
    def run(batches):
        from pyspark import TaskContext

        pair = _loaded(path_a, path_b)
        portion = TaskContext.get().partitionId() << 32
        rows, parts, held = [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _schema(ENCODED))
                if (links := _links(portion, parts, stripes)) is not None:
                    yield links

        for batch in batches:
            for doc_id, (counts, codes) in zip(batch.column("doc_id").to_pylist(), pair.documents(batch.column("text").to_pylist()), strict=True):
                rows.append(dict(zip(("portion", "idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (portion, len(rows), doc_id, *counts), strict=True)))
                parts.append(codes)
                held += len(codes)
                if held >= PORTION_LINKS or len(rows) >= PORTION_DOCS:
                    yield from close()
                    portion, rows, parts, held = portion + 1, [], [], 0
        yield from close()
        trim()

    return run


def _joined(blobs: pd.Series, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def _counted(stripes: int, rows: int, width: int):
    """A dense block of one stripe (or part of it): every link added to its cell; non-empty cells, and those that are their row's largest."""

    def run(key, group: pd.DataFrame) -> pd.DataFrame:
        codes, totals = _joined(group["codes"], np.uint64), _joined(group["totals"], np.uint64)
        block = np.zeros((rows, width), np.uint32 if int(totals.sum()) < 1 << 32 else np.uint64)
        row, column = ((codes >> np.uint64(A_BITS)) // np.uint64(stripes)).astype(np.int64), (codes & np.uint64((1 << A_BITS) - 1)).astype(np.int64)
        np.add.at(block, (row, column), totals.astype(block.dtype))
        best = block.max(axis=1)
        codes, first = np.unique(codes, return_index=True)
        row, column = row[first], column[first]
        found = block[row, column]
        out = pd.DataFrame({"stripe": [key[0]], "part": [key[1]], "codes": [codes.tobytes()], "totals": [found.astype(np.uint64).tobytes()], "best": [(found == best[row]).tobytes()]})
        del block
        trim()
        return out

    return run


def _scored(key, links: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """What the links of one part of a stripe add to their documents, packed by portion."""
    known, totals, best = _joined(counts["codes"], np.uint64), _joined(counts["totals"], np.uint64).astype(np.int64), _joined(counts["best"], np.bool_)
    out = []
    for r in links.itertuples(index=False):
        at = np.searchsorted(known, np.frombuffer(r.codes, np.uint64))
        spread, docs, times = np.frombuffer(r.spread, np.uint32), np.frombuffer(r.docs, np.uint16), np.frombuffer(r.times, np.uint32).astype(np.int64)
        at = np.repeat(at, spread)
        own, place = np.unique(docs, return_inverse=True)
        n_best, count_sum = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        np.add.at(n_best, place, times * best[at])
        np.add.at(count_sum, place, times * totals[at])
        out.append((r.portion, own.tobytes(), n_best.astype(np.uint32).tobytes(), count_sum.tobytes()))
    return pd.DataFrame(out, columns=["portion", "docs", "n_best", "count_sum"])


def _added(key, group: pd.DataFrame) -> pd.DataFrame:
    docs = _joined(group["docs"], np.uint16).astype(np.int64)
    n = int(docs.max()) + 1
    n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(n_best, docs, _joined(group["n_best"], np.uint32).astype(np.int64))
    np.add.at(count_sum, docs, _joined(group["count_sum"], np.int64))
    met = np.unique(docs)
    return pd.DataFrame({"portion": key[0], "idx": met.astype(np.int32), "n_best": n_best[met], "count_sum": count_sum[met]})


def encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = 100) -> DataFrame:
    """The written table of documents (stripe null) and of links by portion and stripe."""
    spark: SparkSession = ready(docs.sparkSession)
    folder = new_dir(spark, "alignment")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts.mapInArrow(_encode(path_a, path_b, stripes), ENCODED).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(ENCODED).parquet(folder)


def link_counts(links: DataFrame, path_a: str, path_b: str, stripes: int = 100, part_bytes: int = 32 << 20, fan_in: int = 16) -> tuple[DataFrame, dict[int, int]]:
    """(stripe, part 0, codes, totals, best) of all links, written; and into how many parts of at most about part_bytes each stripe is dealt."""
    spark = links.sparkSession
    sizes = links.groupBy("stripe").agg(F.sum(F.length("codes") + F.length("totals") + F.length("spread") + F.length("docs") + F.length("times")).alias("size")).collect()
    parts = {r.stripe: -(-r["size"] // part_bytes) for r in sizes}
    pair = _loaded(path_a, path_b)
    block = _counted(stripes, -(-len(pair.bytes_b) // stripes), max(pair.bytes_a) + 1)
    now, most = with_part(links, parts).select("stripe", "part", "codes", "totals"), max(parts.values(), default=1)
    kind = "stripe int, part int, codes binary, totals binary, best binary"
    while True:
        now = now.groupBy("stripe", "part").applyInPandas(block, kind)
        if most == 1:
            break
        now, most = now.select("stripe", F.floor(F.col("part") / fan_in).cast("int").alias("part"), "codes", "totals"), -(-most // fan_in)
    folder = new_dir(spark, "alignment-counts")
    now.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(kind).parquet(folder), parts


def with_part(links: DataFrame, parts: dict[int, int]) -> DataFrame:
    """links with the part of its stripe to which each row's portion belongs."""
    of = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.create_map(F.lit(0), F.lit(1))
    return links.withColumn("part", F.pmod(F.xxhash64("portion"), of[F.col("stripe")]).cast("int"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = 100, part_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a: a byte-level vocabulary of `tokenizers`; path_b: a `sentencepiece` model; both at the same place on all workers. Null and empty texts,
    and those whose tokens do not give back a space and the text, have no tokens: zeros and an empty digest. Special tokens'
    strings are ordinary text. Repeated rows and null ids each get a row and count each time; further columns are ignored, whatever their
    names; texts of any length are taken whole; an empty table gives an empty result. Of equal counts all are best.
    """
    table = encoded(docs, path_a, path_b, id_col, text_col, stripes)
    links = table.where("stripe is not null")
    counts, parts = link_counts(links, path_a, path_b, stripes, part_bytes)
    copies = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]) if parts else F.create_map(F.lit(0), F.lit(1))
    there = counts.withColumn("part", F.explode(F.sequence(F.lit(0), copies[F.col("stripe")].cast("int") - 1)))
    dealt = with_part(links, parts).select("stripe", "part", "portion", "codes", "spread", "docs", "times")
    scored = dealt.groupBy("stripe", "part").cogroup(there.groupBy("stripe", "part")).applyInPandas(_scored, "portion long, docs binary, n_best binary, count_sum binary")
    added = scored.groupBy("portion").applyInPandas(_added, "portion long, idx int, n_best long, count_sum long")
    own = table.where("stripe is null").select("portion", "idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(added, ["portion", "idx"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
