"""Substring de-duplication over sliding runs of sentences.

Every run of consecutive sentences is hashed: from each sentence on, the fewest
(two at least) that have the wanted number of words, or the whole of a text that has
fewer; and back from the end of each sentence in the same way, so that a repeated
passage is covered to its last sentence wherever it ends. Of equal runs anywhere, the first (by doc_id and place) stays; sentences that
any other one covers go. Only hashes are joined: a first pass finds those
that occur twice, a second one asks for the places of these alone.

The hash of a word is that of a polynomial over its bytes, the hash of a run that of one over the hashes of its words, taken from sums
up to each place, so that all words and runs of a batch of texts take a few array operations, however they overlap.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import keep, text_of, without

MIN_SENTENCES = 2
MIN_WORDS = 15
LONG = 16
#: Words that decide on a cut, and how many places on either side it is compared with.
GRAM = 3
REACH = 3
#: Bytes of text that are cut at once (a longer text goes alone).
PIECE_BYTES = 1 << 21
#: Bytes in which the words that are hashed in one go begin, and the longest word of those.
BLOCK = 1 << 18
LONG_WORD = 1 << 16

_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_ENDS = np.isin(np.arange(256), list(b".!?"))
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)
_BACK = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], dtype=np.uint64)
_FAR = np.iinfo(np.uint64).max
#: What each byte stands for in the hash of its word: A-Z as a-z, white space as nothing.
_BYTES = np.array(
    [[0 if _WHITE[b] else xxhash.xxh64_intdigest(bytes([b]).lower(), k) for b in range(256)] for k in range(2)], dtype=np.uint64
)


@functools.lru_cache(maxsize=8)
def _powers(k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2 to the ``bits`` powers of base ``k`` and of its inverse."""
    n = (1 << bits) - 1
    power, back = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b)))) for b in (_BASES[k], _BACK[k]))
    return power, back


def _mixed(found: np.ndarray, k: int) -> np.ndarray:
    found = (found ^ found >> np.uint64(32)) * _BASES[1 - k]
    return found ^ found >> np.uint64(29)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two numbers for each word, A-Z in lower case: those of a polynomial over its bytes, or of xxHash3 beyond ``LONG_WORD``.

    Words are taken in blocks, so a long text takes no more memory than a short one.
    """
    out = np.empty((len(starts), 2), dtype=np.uint64)
    if not len(starts):
        return out
    long = ends - starts > LONG_WORD
    cell = starts // BLOCK
    cuts = (np.flatnonzero((cell[1:] != cell[:-1]) | long[1:] | long[:-1]) + 1).tolist()
    bits = (BLOCK + LONG_WORD).bit_length()
    for low, high in zip([0, *cuts], [*cuts, len(starts)], strict=True):
        base = starts[low]
        if long[low]:
            h = xxhash.xxh3_128_intdigest(data[base : ends[low]].tobytes().lower())
            out[low] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
            continue
        block, at = data[base : ends[high - 1]], starts[low:high] - base
        for k in range(2):
            power, back = _powers(k, bits)
            out[low:high, k] = _mixed(np.add.reduceat(_BYTES[k][block] * power[: len(block)], at) * back[at], k)
    return out


@dataclass
class Cut:
    """Sentences and runs of several texts, numbered on from text to text."""

    words: np.ndarray  # words up to the start of each sentence, and all of them last
    text: np.ndarray  # of each sentence
    firsts: np.ndarray  # first sentence of each text, and the number of all last
    start: np.ndarray  # of each run: first sentence
    stop: np.ndarray  # last sentence + 1
    hashes: np.ndarray  # two numbers

    def sentences(self, k: int) -> np.ndarray:
        """Number of the first word of each sentence of text ``k``, counted in the text."""
        found = self.words[self.firsts[k] : self.firsts[k + 1]]
        return found - found[0] if len(found) else found


def _sentence_ends(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``ends`` with those inside sentences of more than ``LONG`` words.

    There a word is an end if the hash of it and the words before it is the least of its neighbours', so a passage is cut alike
    wherever in a sentence it stands, but for a few words at its ends. Of equal ones all are ends, as text
    that repeats itself must be cut alike everywhere too.
    """
    last = np.flatnonzero(ends)
    sizes = np.diff(last, prepend=-1)
    if not (sizes > LONG).any():
        return ends
    sentence = np.repeat(np.arange(len(last)), sizes)
    place = np.arange(len(ends)) - np.repeat(last + 1 - sizes, sizes)
    gram = np.zeros(len(marks), dtype=np.uint64)
    for back in range(GRAM):
        shifted = np.concatenate([np.zeros(back, dtype=np.uint64), marks[: len(marks) - back]])
        gram = gram * _BASES[0] + shifted
    gram ^= gram >> np.uint64(31)
    gram[place < GRAM - 1] = _FAR
    least = gram.copy()
    for step in range(1, REACH + 1):
        same = sentence[step:] == sentence[:-step]
        least[step:] = np.where(same, np.minimum(least[step:], gram[:-step]), least[step:])
        least[:-step] = np.where(same, np.minimum(least[:-step], gram[step:]), least[:-step])
    return ends | ((gram == least) & (place >= GRAM - 1) & (sizes > LONG)[sentence])


def cut(texts: list[bytes], min_words: int = MIN_WORDS, with_runs: bool = True) -> Cut:
    """Sentences of texts (UTF-8), and their runs: a sentence ends with a word that ends in . ! or ?, or with its line.

    Words are what white space of ASCII separates, A-Z in lower case. Without ``with_runs`` no run is hashed.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    white = _WHITE[data]
    before = np.concatenate(([True], white[:-1]))
    starts, beyond = np.flatnonzero(~white & before), np.flatnonzero(white & ~before)
    hashes = _word_hashes(data, starts, beyond)
    line = np.searchsorted(np.flatnonzero(data == ord("\n")), starts)
    ends = _ENDS[data[beyond - 1]] | (line != np.append(line[1:], -1))
    ends = _sentence_ends(hashes[:, 1], ends)
    bounds = np.concatenate(([0], np.flatnonzero(ends) + 1))
    text_ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    text = np.searchsorted(text_ends, bounds[:-1], side="right")
    firsts = np.searchsorted(bounds[:-1], np.concatenate(([0], text_ends)))
    if not with_runs:
        none = np.zeros(0, dtype=np.int64)
        return Cut(bounds, text, firsts, none, none, np.zeros((0, 2), dtype=np.uint64))

    first, last = firsts[text], firsts[text + 1]
    every = np.arange(len(text))
    stop = np.maximum(every + MIN_SENTENCES, np.searchsorted(bounds, bounds[:-1] + min_words))
    full = stop <= last
    stop = np.minimum(stop, last)
    ahead = full | (every == first)
    begin = np.minimum(every + 1 - MIN_SENTENCES, np.searchsorted(bounds, bounds[1:] - min_words, side="right") - 1)
    from_here = np.maximum(begin, 0)
    # a run that was found from its start is not taken from its end again
    back = (begin >= first) & ~(ahead[from_here] & (stop[from_here] == every + 1))
    start = np.concatenate([every[ahead], begin[back]])
    stop = np.concatenate([stop[ahead], every[back] + 1])
    return Cut(bounds, text, firsts, start, stop, _run_hashes(hashes, bounds[start], bounds[stop]))


def _run_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty((len(begin), 2), dtype=np.uint64)
    n = len(hashes)
    with np.errstate(over="ignore"):
        for k in range(2):
            power, back = _powers(k, (n + 1).bit_length())
            sums = np.concatenate(([np.uint64(0)], np.add.accumulate(hashes[:, k] * power[:n])))
            out[:, k] = _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64), k)
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Stretches of ``texts`` of about ``PIECE_BYTES``, one text at least."""
    start = size = 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > PIECE_BYTES:
            yield start, k
            start, size = k, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _runs_of(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, twin, start, stop, and the hash of all runs in two numbers."""
    names = ["doc_id", "twin", "start", "stop", "short", "rest"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for low, high in _pieces(texts):
                found = cut(texts[low:high], min_words)
                owner = found.text[found.start]
                ids = pa.array(owner + low)
                columns = [
                    batch.column(0).take(ids),
                    batch.column(1).take(ids),
                    pa.array((found.start - found.firsts[owner]).astype(np.int32)),
                    pa.array((found.stop - found.firsts[owner]).astype(np.int32)),
                    pa.array(found.hashes[:, 0].view(np.int64)),
                    pa.array(found.hashes[:, 1].view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "doc_id long, twin long, start int, stop int, short long, rest long"
    return docs.select("doc_id", "twin", F.col("text").cast("binary").alias("text")).mapInArrow(emit, kinds)


def _short_hashes(docs: DataFrame, min_words: int) -> DataFrame:
    """First number of the hash of every run, and how often a batch has it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for low, high in _pieces(texts):
                short, n = np.unique(cut(texts[low:high], min_words).hashes[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(short.view(np.int64)), pa.array(n)], names=["short", "n"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(emit, "short long, n long")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, twin, start, stop of every run that an earlier one equals.

    ``docs``: doc_id, twin (tells rows of the same id apart), text without nulls.
    """
    twice = keep(
        _short_hashes(docs, min_words).groupBy("short").agg(F.sum("n").alias("n")).where("n > 1").select("short"),
        "repeated-hashes",
    )
    # the hashes of a large corpus fit neither a worker nor the driver, so the runs are joined with them
    some = _runs_of(docs, min_words).join(twice, "short", "left_semi")
    some = keep(some, "repeated-runs")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "twin", "start", "stop")
    # written, so that both sides of the join are plain exchanges and a run that many texts share is split
    firsts = keep(some.groupBy("short", "rest").agg(F.min(place).alias("first")), "first-runs")
    return (
        some.join(firsts, ["short", "rest"])
        .where(~(place == F.col("first")))
        .select("doc_id", "twin", "start", "stop")
    )


def deduplicate(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated spans, with n_sentences, n_removed, words_removed and kept_sha256.

    Columns of these names are replaced, others stay. A null text counts as empty and stays null.
    Rows equal in id and text are one document: they keep or lose the same sentences. An empty table gives an empty one.
    """
    added = ["n_sentences", "n_removed", "words_removed", "kept_sha256"]
    base = without(docs, *added, "__twin", "__doc", "__gone")
    text = text_of(base)
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))
    gone = (
        repeated_runs(rows, min_words)
        .groupBy("doc_id", "twin")
        .agg(F.collect_set(F.struct("start", "stop")).alias("__gone"))
    )
    keyed = base.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__twin", F.xxhash64(text))
    match = keyed["__doc"].eqNullSafe(gone["doc_id"]) & (keyed["__twin"] == gone["twin"])
    marked = keyed.join(gone, match, "left").select(*[keyed[f"`{c}`"] for c in base.columns], gone["__gone"])
    text_at = [c.lower() for c in base.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    names = [*base.columns, *added]
    schema += ", n_sentences long, n_removed long, words_removed long, kept_sha256 string"

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            data = [(t or "").encode("utf-8", "replace") for t in texts]
            spans = batch.column(batch.num_columns - 1).to_pylist()
            out: list[list] = [[], [], [], []]
            for low, high in _pieces(data):
                found = cut(data[low:high], min_words, with_runs=False)
                for at in range(low, high):
                    starts = found.sentences(at - low)
                    kept, lost, words = remove(data[at], starts, [(s["start"], s["stop"]) for s in spans[at] or ()])
                    if lost:
                        texts[at] = kept.decode("utf-8", "replace")
                    for column, value in zip(out, (len(starts), lost, words, hashlib.sha256(kept).hexdigest()), strict=True):
                        column.append(value)
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, pa.string())
            columns += [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.mapInArrow(shorten, schema)


def remove(text: bytes, starts: np.ndarray, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``text``, and the sentences and words that went; ``starts`` are the first words of its sentences."""
    covered = np.zeros(len(starts), dtype=bool)
    for start, stop in spans:
        covered[start:stop] = True
    if not covered.any():
        return text, 0, 0
    white = _WHITE[np.frombuffer(text, dtype=np.uint8)]
    places = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    first = places[starts].tolist()
    sizes = np.diff(np.append(starts, len(places)))
    kept, at = [], 0
    for k in np.flatnonzero(covered).tolist():
        kept.append(text[at : first[k]])
        # the white space after it goes as well
        at = first[k + 1] if k + 1 < len(first) else len(text)
    return b"".join([*kept, text[at:]]).rstrip(b" \n"), int(covered.sum()), int(sizes[covered].sum())
