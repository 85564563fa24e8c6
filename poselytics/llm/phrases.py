"""Phrase collocations from depth-truncated suffix subtrees, partitioned by their prefixes.

Every word begins a suffix: itself and the words after it in its piece, ``DEPTH`` at most. Suffixes are
partitioned vertically, by their first words: a prefix whose suffixes fit the memory budget of
a group goes to one whole; one that is too frequent is extended word by word until each extension fits.
Prefixes are hashed to slots, so that what is counted and broadcast for this has a fixed size.
Small slots share a group. Each group builds its subtree in one task by sorting its suffixes; a node is a run of
suffixes with equal first words, and its count is the sum of the leaves below it.

Nodes above the prefix of their group (an extended prefix lies in several) are added up over groups.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poselytics.llm.common import keep, text_of

DEPTH = 5
MIN_COUNT = 100
TOP = 2000
#: Suffixes that a group's subtree may hold; least and most slots that prefixes of one length are hashed to.
BUDGET = 2_000_000
FEWEST_SLOTS = 1 << 10
MOST_SLOTS = 1 << 20
#: Groups of suffixes that end before their prefix is long enough, for each length.
ENDS = 64
#: Words of text that a task gathers before it sorts them, and different words that it numbers.
CHUNK = 1 << 21
VOCABULARY = 1 << 19
#: Bits of the filter of frequent words (8 MB).
FILTER_BITS = 1 << 26
#: Partial rankings of a language, so that no task orders all its candidates.
SALTS = 16

_breaks = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PHRASE = "lang string, phrase string, f long"


def _tokens(text: bytes) -> list[bytes]:
    """Words in lower case, a full stop for every end of a piece: no word contains one."""
    return _breaks.sub(b" . ", text.lower()).split()


class Numbering(dict):
    """Numbers of words (or languages) from 1, and the hash of each."""

    def __init__(self) -> None:
        super().__init__()
        self.names: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, name: bytes) -> int:
        n = self[name] = len(self.names)
        self.names.append(name)
        self.hashes.append(xxhash.xxh3_64_intdigest(name))
        return n


class Chunk:
    """Texts as one row of word numbers; 0 ends a piece."""

    def __init__(self) -> None:
        self.words, self.langs = Numbering(), Numbering()
        self.words[b"."] = 0
        self._parts: list[np.ndarray] = []
        self._lang_parts: list[tuple[int, int]] = []
        self.size = 0

    def add(self, lang: bytes, text: bytes) -> None:
        found = _tokens(text)
        found.append(b".")
        self._parts.append(np.fromiter(map(self.words.__getitem__, found), dtype=np.int32, count=len(found)))
        self._lang_parts.append((self.langs[lang], len(found)))
        self.size += len(found)

    @property
    def full(self) -> bool:
        return self.size >= CHUNK or len(self.words.names) >= VOCABULARY or len(self.langs.names) >= VOCABULARY

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and language number at each place, ``DEPTH`` empty places at the end."""
        words = np.concatenate([*self._parts, np.zeros(DEPTH, dtype=np.int32)])
        numbers, sizes = zip(*self._lang_parts, strict=True)
        langs = np.repeat(np.array(numbers, dtype=np.int64), sizes)
        return words, np.concatenate([langs, np.zeros(DEPTH, dtype=np.int64)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk = Chunk()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            chunk.add(lang, text)
            if chunk.full:
                yield chunk
                chunk = Chunk()
    if chunk.size:
        yield chunk


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose low bits depend on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def _prefix_hashes(words: np.ndarray, langs: np.ndarray, at: np.ndarray, chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of prefix: which of ``at`` have one, and the hash of language and words."""
    word_hash = np.array(chunk.words.hashes, dtype=np.uint64)
    lang_hash = np.array(chunk.langs.hashes, dtype=np.uint64)
    found = _mixed(lang_hash[langs[at]] ^ np.uint64(DEPTH))
    alive = np.ones(len(at), dtype=bool)
    for k in range(DEPTH):
        here = words[at + k]
        alive = alive & (here > 0)
        found = _mixed(found * np.uint64(3) + word_hash[here])
        yield alive, found


# first pass: words, and how many suffixes each slot of prefixes has


def slots_for(docs: DataFrame, budget: int) -> int:
    """Slots of prefixes: four for each group that the texts fill, a word taken as six bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << int(4 * size / 6 / budget).bit_length()))


def prefix_counts(docs: DataFrame, n_slots: int) -> DataFrame:
    """lang, word, hash and n for every word; with level 1 to ``DEPTH`` and the slot in ``hash``, n for every slot of prefixes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros((DEPTH, n_slots), dtype=np.int64)
        for chunk in _chunks(batches):
            words, langs = chunk.arrays()
            at = np.flatnonzero(words)
            for k, (alive, found) in enumerate(_prefix_hashes(words, langs, at, chunk)):
                slots[k] += np.bincount(_slots(found[alive], n_slots), minlength=n_slots)
            key, n = np.unique(langs[at] << 32 | words[at], return_counts=True)
            lang, word = (key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()
            lang_hash, word_hash = chunk.langs.hashes, chunk.words.hashes
            for start in range(0, len(key), 1 << 16):
                part = slice(start, start + (1 << 16))
                hashes = [_word_hash(lang_hash[i], word_hash[j]) for i, j in zip(lang[part], word[part], strict=True)]
                columns = [
                    pa.array([0] * len(hashes), pa.int32()),
                    pa.array([chunk.langs.names[i].decode() for i in lang[part]]),
                    pa.array([chunk.words.names[j].decode("utf-8", "replace") for j in word[part]]),
                    pa.array(hashes, pa.int64()),
                    pa.array(n[part]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["level", "lang", "word", "hash", "n"])
        level, slot = np.nonzero(slots)
        columns = [
            pa.array((level + 1).astype(np.int32)),
            pa.nulls(len(level), pa.string()),
            pa.nulls(len(level), pa.string()),
            pa.array(slot),
            pa.array(slots[level, slot]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["level", "lang", "word", "hash", "n"])

    rows = docs.mapInArrow(count, "level int, lang string, word string, hash long, n long")
    return rows.groupBy("level", "lang", "word", "hash").agg(F.sum("n").alias("n"))


def _slots(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes % np.uint64(n)).astype(np.int64)


def _word_hash(lang: int, word: int) -> int:
    """Place of a language's word in the filter."""
    return ((lang * 0x9E3779B97F4A7C15 ^ word) * 0xC2B2AE3D27D4EB4F >> 20) % FILTER_BITS


def word_filter(counts: DataFrame, least: int) -> np.ndarray:
    """Bits, set at the hash of every word of ``least`` occurrences. Of fixed size; more words only make it let more pass."""
    block = 1 << 16
    frequent = counts.where((F.col("level") == 0) & (F.col("n") >= least)).select("hash").distinct()

    def pack(key, rows):
        import pandas as pd

        bits = np.zeros(block, dtype=np.uint8)
        bits[rows["hash"].to_numpy() % block] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    blocks = frequent.withColumn("block", F.expr(f"hash div {block}")).groupBy("block").applyInPandas(pack, "block long, bits binary")
    found = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in blocks.toLocalIterator():  # FILTER_BITS / 8 bytes in all
        at = r["block"] * block // 8
        found[at : at + block // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return found


@dataclass
class Partition:
    """Group of each slot of prefixes, by length; -1 where the prefix is to be extended."""

    groups: np.ndarray

    @classmethod
    def of(cls, slots: np.ndarray, budget: int) -> Partition:
        """Slots over the budget are extended, the last level never: its prefixes are whole suffixes. Others share groups."""
        groups = np.full(slots.shape, -1, dtype=np.int64)
        n = 0
        for level in range(len(slots)):
            fits = (slots[level] <= budget) | (level == len(slots) - 1)
            size = 0
            for slot in np.flatnonzero(fits).tolist():
                if size and size + slots[level, slot] > budget:
                    n, size = n + 1, 0
                size += int(slots[level, slot])
                groups[level, slot] = n
            n += 1
        return cls(groups)


def partition(counts: DataFrame, n_slots: int, budget: int) -> Partition:
    slots = np.zeros((DEPTH, n_slots), dtype=np.int64)
    found = counts.where("level > 0").select("level", "hash", "n").toPandas()  # DEPTH * n_slots rows at most
    slots[found["level"] - 1, found["hash"]] = found["n"]
    return Partition.of(slots, max(budget, 2 * int(slots[0].sum()) // n_slots))


# second pass: suffixes by group


def _pack(names: list[bytes], langs: list[bytes], columns: list[np.ndarray]) -> bytes:
    """Words, languages, and columns of numbers of them as one compressed block."""
    words, tongues = b" ".join(names), b" ".join(x.hex().encode() for x in langs)
    wide = [c.astype("<u4").tobytes() for c in columns]
    head = struct.pack("<4Q", len(words), len(tongues), len(columns[0]), len(columns))
    return zstandard.compress(head + words + tongues + b"".join(wide), 1)


def _unpack(block: bytes) -> tuple[list[bytes], list[bytes], np.ndarray]:
    data = zstandard.decompress(block)
    n_words, n_langs, n, width = struct.unpack_from("<4Q", data)
    words, langs = data[32 : 32 + n_words], data[32 + n_words : 32 + n_words + n_langs]
    columns = np.frombuffer(data[32 + n_words + n_langs :], dtype="<u4").reshape(width, n)
    return words.split(b" "), [bytes.fromhex(x.decode()) for x in langs.split(b" ")], columns


def _distinct(columns: list[np.ndarray], times: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of numbers below 2**32 in ascending order, each once, with the sum of its ``times``."""
    wide = [c.astype(np.uint64) for c in columns]
    keys = [wide[k] << np.uint64(32) | wide[k + 1] for k in range(0, len(wide), 2)]
    order = np.lexsort(keys[::-1])
    changes = np.ones(len(order), dtype=bool)
    if len(order):
        changes[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(changes)
    kept = order[first]
    return [c[kept] for c in columns], np.add.reduceat(times[order], first) if len(first) else times[:0]


def suffixes(docs: DataFrame, plan: Partition, frequent: np.ndarray) -> DataFrame:
    """grp, level and blocks of suffixes, equal ones of a chunk counted together.

    ``level`` is the length of the group's prefixes. A word that is not frequent ends a piece
    here: no frequent phrase has it. A suffix that ends before its prefix is long enough goes to a
    group of such ends.
    """
    sent = docs.sparkSession.sparkContext.broadcast((plan.groups, frequent))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, bits = sent.value
        n_slots, beyond = groups.shape[1], int(groups.max()) + 1
        for chunk in _chunks(batches):
            words, langs = chunk.arrays()
            _drop_rare(words, langs, chunk, bits)
            at = np.flatnonzero(words)
            columns = [langs[at]]
            group, level = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
            for k, (alive, hashes) in enumerate(_prefix_hashes(words, langs, at, chunk)):
                columns.append(np.where(alive, words[at + k], 0))
                slot = _slots(hashes, n_slots)
                here = groups[k][slot]
                fits = alive & (level == 0) & (here >= 0)
                group[fits], level[fits] = here[fits], k + 1
                ends = alive & (level == 0) & (words[np.minimum(at + k + 1, len(words) - 1)] == 0)
                group[ends], level[ends] = beyond + k * ENDS + slot[ends] % ENDS, k + 2
            yield from _blocks(chunk, columns, group, level)

    return docs.mapInArrow(cut, "grp long, level int, block binary")


def _drop_rare(words: np.ndarray, langs: np.ndarray, chunk: Chunk, bits: np.ndarray) -> None:
    """Words that are not in the filter become ends of pieces."""
    at = np.flatnonzero(words)
    key, back = np.unique(langs[at] << 32 | words[at], return_inverse=True)
    lang_hash, word_hash = chunk.langs.hashes, chunk.words.hashes
    pairs = zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist(), strict=True)
    place = np.array([_word_hash(lang_hash[i], word_hash[j]) for i, j in pairs], dtype=np.int64)
    known = bits[place >> 3] >> (place & 7) & 1 == 1 if len(place) else np.zeros(0, dtype=bool)
    words[at[~known[back]]] = 0


def _blocks(chunk: Chunk, columns: list[np.ndarray], group: np.ndarray, level: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each group and level, with its own short list of words."""
    keys = group << 3 | level
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for start, stop in zip(edges, [*edges[1:], len(keys)], strict=True):
        rows = order[start:stop]
        part, times = _distinct([c[rows] for c in columns], np.ones(stop - start, dtype=np.int64))
        used, packed = np.unique(np.concatenate([np.zeros(1, dtype=np.int32), *part[1:]]), return_inverse=True)
        tongues, lang = np.unique(part[0], return_inverse=True)
        numbers = [lang, *packed[1:].reshape(DEPTH, -1), times]  # number 0 stands for no word
        names = [chunk.words.names[k] for k in used.tolist()]
        block = _pack(names, [chunk.langs.names[k] for k in tongues.tolist()], numbers)
        arrays = [pa.array([int(keys[start]) >> 3]), pa.array([int(keys[start]) & 7], pa.int32()), pa.array([block])]
        yield pa.RecordBatch.from_arrays(arrays, names=["grp", "level", "block"])


class _Tree:
    """A group's subtree: its suffixes as sorted rows of numbers."""

    def __init__(self, level: int, budget: int) -> None:
        self.level, self.budget = level, budget
        self.words, self.langs = Numbering(), Numbering()
        self.words[b""] = 0
        self._rows: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, block: bytes) -> None:
        names, langs, columns = _unpack(block)
        number = np.fromiter(map(self.words.__getitem__, names), dtype=np.uint32, count=len(names))
        tongue = np.fromiter(map(self.langs.__getitem__, langs), dtype=np.uint32, count=len(langs))
        self._rows.append(([tongue[columns[0]], *[number[c] for c in columns[1:-1]]], columns[-1].astype(np.int64)))
        self.size += len(columns[0])
        if self.size > 2 * self.budget:
            self._merge()

    def _merge(self) -> None:
        """Equal suffixes of different chunks become one."""
        columns = [np.concatenate([rows[0][k] for rows in self._rows]) for k in range(DEPTH + 1)]
        times = np.concatenate([rows[1] for rows in self._rows])
        self._rows = [_distinct(columns, times)]
        self.size = len(self._rows[0][1])

    def nodes(self, least: int) -> Iterator[tuple[str, str, int]]:
        """Language, phrase and count of the nodes: of all above the level, of others from ``least`` on."""
        if not self._rows:
            return
        self._merge()
        columns, times = self._rows[0]
        changes = np.zeros(len(times), dtype=bool)
        changes[0] = True
        changes[1:] = columns[0][1:] != columns[0][:-1]
        for depth in range(1, DEPTH + 1):
            here = columns[depth]
            changes[1:] |= here[1:] != here[:-1]
            first = np.flatnonzero(changes)
            counts = np.add.reduceat(times, first)
            wanted = (here[first] > 0) & ((counts >= least) | (depth < self.level))
            for row, n in zip(first[wanted].tolist(), counts[wanted].tolist(), strict=True):
                phrase = b" ".join(self.words.names[columns[k][row]] for k in range(1, depth + 1))
                yield self.langs.names[columns[0][row]].decode(), phrase.decode("utf-8", "replace"), n


def frequencies(blocks: DataFrame, least: int, budget: int) -> DataFrame:
    """lang, phrase and f of all phrases of ``least`` occurrences or more: one subtree for each group."""
    dealt = blocks.repartition("grp").sortWithinPartitions("grp")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group, tree = None, None
        for batch in batches:
            for grp, level, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != open_group:
                    if tree:
                        yield from _rows(tree.nodes(least))
                    open_group, tree = grp, _Tree(level, budget)
                tree.add(block)
        if tree:
            yield from _rows(tree.nodes(least))

    parts = dealt.mapInArrow(build, _PHRASE)
    return parts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _rows(nodes: Iterator[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, str, int]] = []
    for node in nodes:
        held.append(node)
        if len(held) == 1 << 14:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["lang", "phrase", "f"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], names=["lang", "phrase", "f"])


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of all candidates that no longer one of equal count contains.

    ``found``: every frequent phrase of one word or more with its count f; ``totals``: n by lang.
    """
    words = F.split("phrase", " ")
    phrases = found.withColumn("w", words).where(F.size("w") > 1)
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.array_join(F.slice("w", F.lit(1), F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")).drop("w")
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.withColumn("above", exact["a"] * exact["n"] * F.lit(1000).cast("decimal(4,0)"))
    cuts = cuts.withColumn("below", exact["l"] * exact["r"]).withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("least"))
    # a longer candidate of equal count has one a word longer of equal count between itself and the phrase
    longer = phrases.where(F.size("w") > 2)
    inner = F.array(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1))
    inside = longer.select("lang", F.explode(inner).alias("w"), "f").select("lang", F.array_join("w", " ").alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("outer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").where("outer is null or outer < least.a")
    return kept.select("lang", "phrase", "least.a", "least.l", "least.r", "least.n", "least.score")


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank; partial rankings bound what one task orders last."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.drop("salt").withColumn("rank", place).where(F.col("rank") <= top)


def mine(docs: DataFrame, *, least: int = MIN_COUNT, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of two to ``DEPTH`` words of each language.

    ``docs``: lang and text, other columns are ignored. A null text is empty, a null language ``und``; repeated rows
    count repeatedly; empty texts and empty tables have no phrases. Ties go by a, then by the phrase's bytes.
    """
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).cast("binary").alias("lang"), text_of(docs).cast("binary").alias("text"))
    n_slots = slots_for(rows, budget)
    counts = keep(prefix_counts(rows, n_slots), "prefix-counts")
    totals = keep(counts.where("level = 0").groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    blocks = suffixes(rows, partition(counts, n_slots, budget), word_filter(counts, least))
    found = keep(frequencies(blocks, least, budget), "phrases")
    return ranked(scored(found, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
