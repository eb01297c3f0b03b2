"""Language-model scoring with a log-frequency Bloom filter.

The filter holds quantised bigram counts of the training documents: a bigram of count c is inserted as (bigram, j) for j up to
log2(c), those seen once too. Its count is read back by repeated membership probes, j = 0, 1, ... until one fails. The
filter grows with the bigrams counted: it is made of segments, a bigram's bits all lie in the segment of its hash block, and
each segment has as many bits as its own insertions need. No process holds more than a segment.

Neither words nor bigrams are bounded in number, so nothing is broadcast: documents are dealt into chunks, each chunk sends
its different words and bigrams with their training counts to the hash blocks that they fall in, and to no others. A block's task adds the counts, builds the
block's segment, probes it for the bigrams asked, and the answers meet the chunk's texts again, with a row of four totals for each chunk. Blocks and
chunks both grow with the corpus, so that the tasks' memory does not; what is sent is a number of bytes for each entry, as large as the
corpus at most.

The model: P(w | v) = k * c(v, w) / c(v) + (1 - k) * (c(w) + 1) / (N + V + 1), with c(v, w) from the filter and 0 where that has
none, and k the share of bigram occurrences that would be left with one occurrence less of each bigram. A document's first word takes the second term alone; the end token has bigrams like a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._cluster import blocks_for, ready
from ._words import PLACE, U, Words, mix, steps
from .jaccard import _block

END = U(0xD6E8FEB86659FD93)
PROBES = 5
#: Bits of the filter for each insertion, for a false-positive rate of about 1 %.
BITS_EACH = 10


def _streams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes with an end after each text's words, and where each text begins (and the last ends)."""
    n = len(words)
    first = words.first + np.arange(n + 1)
    out = np.empty(len(words.hashes) + n, dtype=U)
    ends = first[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = words.hashes, END
    return out, first


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbours within a text, and the place of each one's second token."""
    if len(tokens) < 2:
        return tokens[:0], np.zeros(0, np.int64)
    second = np.ones(len(tokens), bool)
    second[first[:-1]] = False
    at = np.flatnonzero(second)
    return mix(tokens[at - 1] * PLACE[3] + tokens[at] * PLACE[4]), at


def _bits(place: np.ndarray, level: int, bits: int) -> np.ndarray:
    """PROBES bit numbers of (place, level), one row a probe."""
    h = mix((place.astype(U) + U(1)) * PLACE[5] + np.array([level], U) * PLACE[6])
    step = (h >> U(32)) | U(1)
    return ((h + np.arange(PROBES, dtype=U)[:, None] * step) & U(0xFFFFFFFF)) * U(bits) >> U(32)


def _levels(places: np.ndarray, counts: np.ndarray, each: int = 1 << 18) -> np.ndarray:
    """What a block's segment, built from its counts, answers for each place: 0 for none, else 1 + the last level found."""
    level = np.full(len(counts), -1)
    level[counts > 0] = np.log2(counts[counts > 0]).astype(np.int64)
    bits = max(64, int((level + 1).sum()) * BITS_EACH)
    field = np.zeros(bits, dtype=bool)
    for j in range(int(level.max(initial=-1)) + 1):
        own = places[level >= j]
        for a in range(0, len(own), each):
            field[_bits(own[a : a + each], j, bits).ravel().astype(np.int64)] = True
    out = np.zeros(len(places), np.uint8)
    for a in range(0, len(places), each):
        left = np.arange(a, min(a + each, len(places)))
        for j in range(64):
            if not len(left):
                break
            left = left[field[_bits(places[left], j, bits).astype(np.int64)].all(axis=0)]
            out[left] = j + 1
    return out


#: Count by answer, about the mean of a level's counts.
COUNT_OF = np.array([0, 1, 2.4, *(1.4 * 2.0 ** np.arange(2, 64))])


def _chunk_words(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for at, to, words in steps(table.column("text").combine_chunks()):
        yield at, to, *_streams(words)


def _tallied(parts: list[np.ndarray], weights: list[np.ndarray], n_blocks: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Different hashes in order, their sums of weights, and the range of each block."""
    hashes, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.bincount(place, weights=np.concatenate(weights), minlength=len(hashes)).astype(np.uint64)
    edges = np.searchsorted(_block(hashes, n_blocks)[0], np.arange(n_blocks + 1))
    return hashes, counts, list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def _ask(n_blocks: int):
    """A chunk's different tokens and bigrams by block, each with its training count there, for the blocks that have any."""

    def run(table: pa.Table) -> pa.Table:
        train = ~table.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        parts, weights, pairs, pair_weights = [], [], [], []
        for at, to, tokens, first in _chunk_words(table):
            parts.append(tokens)
            weights.append(np.repeat(train[at:to], np.diff(first)))
            found, second = _bigrams(tokens, first)
            pairs.append(found)
            pair_weights.append(weights[-1][second])
        hashes, counts, spans = _tallied(parts, weights, n_blocks)
        found, pair_counts, pair_spans = _tallied(pairs, pair_weights, n_blocks)
        places = found.astype(np.uint32)  # the low bits; the block is of the high ones
        blocks = [k for k in range(n_blocks) if spans[k][0] < spans[k][1] or pair_spans[k][0] < pair_spans[k][1]]
        part = lambda x, spans, shown: pa.array([shown(x[slice(*spans[k])]) for k in blocks], pa.binary())
        columns = {"hashes": part(hashes, spans, np.ndarray.tobytes), "counts": part(counts, spans, _small), "places": part(places, pair_spans, np.ndarray.tobytes), "pair_counts": part(pair_counts, pair_spans, _small)}
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"block": pa.array(blocks, pa.int64()), "chunk": pa.array([chunk] * len(blocks), pa.int64())} | columns)

    return run


def _small(counts: np.ndarray) -> bytes:
    """In the fewest bytes a number that hold the largest."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(counts) or counts.max() <= np.iinfo(t).max)
    return counts.astype(kind).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.uint64)


def _totals(table: pa.Table, keys: str, kind: type, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Different keys asked in a block, their totals, the place of each asked one, and the range of each row."""
    asked = [np.frombuffer(x, kind) for x in table.column(keys).to_pylist()]
    lens = [len(x) for x in asked]
    given = [_wide(c, n) for c, n in zip(table.column(counts).to_pylist(), lens, strict=True)]
    found, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.zeros(len(found), np.uint64)
    np.add.at(total, place, np.concatenate(given))
    ends = np.cumsum(lens).tolist()
    return found, total, place, list(zip([0, *ends[:-1]], ends, strict=True))


def _answer(table: pa.Table) -> pa.Table:
    """Totals of each chunk's tokens in a block and the filter's levels of its bigrams. The block's first row has its tokens, different ones, bigrams and repeated ones, others have 0."""
    _, total, place, spans = _totals(table, "hashes", U, "counts")
    places, pair_total, pair_place, pair_spans = _totals(table, "places", np.uint32, "pair_counts")
    levels = _levels(places, pair_total)[pair_place]
    rows, pairs = table.num_rows, int(pair_total.sum())
    out = {"n": [b - a for a, b in spans], "totals": [_small(total[place[a:b]]) for a, b in spans], "levels": [levels[a:b].tobytes() for a, b in pair_spans]}
    sums = (int(total.sum()), int((total > 0).sum()), pairs, pairs - int((pair_total > 0).sum()))
    out |= {name: [n] + [0] * (rows - 1) for name, n in zip(SUMS, sums, strict=True)}
    return pa.table({"chunk": table.column("chunk"), "block": table.column("block")} | {k: pa.array(v, pa.binary() if k in ("totals", "levels") else pa.int64()) for k, v in out.items()})


def _score():
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(texts):
            return pa.table({k: pa.array([], t) for k, t in RESULT.items()})
        answers = answers.sort_by("block")
        n_train, kinds, n_pairs, again = (int(answers.column(c)[0].as_py()) for c in SUMS)
        answers = answers.slice(1)
        totals = np.concatenate([_wide(x, n) for x, n in zip(answers.column("totals").to_pylist(), answers.column("n").to_pylist(), strict=True)])
        found_of = COUNT_OF[np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)]
        portions = list(_chunk_words(texts))
        hashes = np.unique(np.concatenate([p[2] for p in portions]))
        every = np.unique(np.concatenate([_bigrams(*p[2:])[0] for p in portions]))
        base_of = np.log10((totals.astype(float) + 1) / (n_train + 1 * (kinds + 1)))
        k = again / n_pairs if n_pairs else 0.0
        size = len(texts)
        n_tokens, n_known, base, score = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        for at, to, tokens, first in portions:
            place = np.searchsorted(hashes, tokens)
            count, unigram = totals[place].astype(float), base_of[place]
            owner = np.repeat(np.arange(to - at), np.diff(first))
            pairs, second = _bigrams(tokens, first)
            before = count[second - 1]
            found = np.minimum(found_of[np.searchsorted(every, pairs)], np.minimum(before, count[second]))
            log_p = unigram.copy()
            log_p[second] = np.log10(k * found / np.maximum(before, 1) + (1 - k) * 10 ** unigram[second])
            n_tokens[at:to] = np.diff(first)
            n_known[at:to] = np.bincount(owner, weights=count > 0, minlength=to - at)
            base[at:to] = np.bincount(owner, weights=unigram, minlength=to - at)
            score[at:to] = np.bincount(owner, weights=log_p, minlength=to - at)
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": n_tokens, "n_known": n_known, "train_tokens": np.full(size, n_train, np.int64), "base_score": base, "score": score})

    return run


#: The training tokens, different ones, bigrams, and those that repeat another.
SUMS = ("tokens", "kinds", "pairs", "again")
RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, chunk_chars: int = 6_000_000) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32 of the id's text modulo `folds` is not `held_out`; a null id is learned from. Null texts are empty:
    one end token. Repeated rows count and score each. Without training rows every token has probability 1 in base_score. An
    empty table gives an empty result; other columns are ignored. Texts are read whole, each by one task.
    """
    ready(docs.sparkSession)
    ids = F.col(id_col).cast("long")
    held = F.coalesce(F.pmod(F.crc32(ids.cast("string").cast("binary")), F.lit(folds)) == held_out, F.lit(False))
    rows = docs.select(ids.alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chars, count = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    chunks = max(blocks_for(chars or 0, chunk_chars), blocks_for(count, 1 << 16))
    n_blocks = blocks_for(chars or 0, 4 * chunk_chars)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long")).repartition("chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_ask(n_blocks), "block long, chunk long, hashes binary, counts binary, places binary, pair_counts binary")
    answers = asked.groupBy("block").applyInArrow(_answer, "chunk long, block long, n long, totals binary, levels binary, tokens long, kinds long, pairs long, again long")
    # the totals come first in each chunk, as block -1
    sums = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS]).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), F.lit(-1).cast("long").alias("block"), *SUMS)
    answers = answers.select("chunk", "block", "n", "totals", "levels").unionByName(sums, allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(), schema)
