"""Cross-tokenizer alignment by products of sparse incidence matrices.

Both tokenizers cut the same bytes. A row of a token-byte incidence matrix holds the bytes
of one token. The product A B' has an entry wherever tokens of both share bytes: the
overlap links. Offsets where tokens of both end cut a text into groups; token-group incidence
matrices multiply to the links within a group. Matrices are compressed rows built
here, and products are formed row by row (Gustavson): each entry of a row of A names a row of B' to be added.

All texts of a batch share one byte axis, so a batch takes one product and no text is a
special case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import BROADCAST_BYTES, free_name, keep, text_of
from poselytics.llm.tokens import MEMORY, WordEncoder, _Words

#: Bytes of text that are aligned at once (a longer text goes alone) and pairs that a task adds up at once.
PIECE_BYTES = 1 << 20
PAIRS = 1 << 22
#: Bytes of a pair and its count.
PAIR_BYTES = 16


@dataclass
class Csr:
    """Compressed rows of a matrix of ones: the columns of row i are ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of_runs(cls, sizes: np.ndarray) -> Csr:
        """Row after row takes the next ``sizes[i]`` columns."""
        starts = np.concatenate(([0], np.cumsum(sizes)))
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_places(cls, column: np.ndarray, width: int) -> Csr:
        """Row i has the one column ``column[i]``."""
        return cls(np.arange(len(column) + 1), column, width)

    @property
    def height(self) -> int:
        return len(self.starts) - 1

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        if len(rows) and (np.diff(self.columns) < 0).any():
            rows = rows[np.argsort(self.columns, kind="stable")]
        sizes = np.bincount(self.columns, minlength=self.width)
        return Csr(np.concatenate(([0], np.cumsum(sizes))), rows, self.height)

    def sizes(self, other: Csr) -> np.ndarray:
        """Entries added up by each row of ``self @ other``, not formed."""
        added = np.diff(other.starts)[self.columns]
        return np.diff(np.concatenate(([0], np.cumsum(added)))[self.starts])

    def __matmul__(self, other: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, column and value of the entries of the product, in order."""
        rows = np.repeat(np.arange(self.height), np.diff(self.starts))
        begin, size = other.starts[self.columns], np.diff(other.starts)[self.columns]
        row = np.repeat(rows, size)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        column = other.columns[np.repeat(begin, size) + inside]
        key = row * max(other.width, 1) + column
        if len(key) and (np.diff(key) < 0).any():
            key = np.sort(key)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        key, value = key[first], np.diff(np.append(first, len(key)))
        return key // max(other.width, 1), key % max(other.width, 1), value


class Vocabulary:
    """The bytes of every token id, one after another."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        return self.bytes[np.repeat(self.starts[ids], sizes) + inside]


def _byte_level(path: str) -> Vocabulary:
    """Tokens of a byte-level vocabulary: printable bytes stand for themselves, others for letters past 255."""
    from tokenizers import Tokenizer

    names = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    back = {b: b for b in range(256) if b not in set(hidden)} | {256 + k: b for k, b in enumerate(hidden)}
    tokens = [b""] * (max(names.values()) + 1)
    for name, k in names.items():
        tokens[k] = bytes(back[ord(c)] for c in name)
    return Vocabulary(tokens)


class PieceEncoder:
    """Encodes texts that begin with a space to ids of a sentence-piece file, which adds that space itself.

    If no piece has a space after anything else, merges never cross into a space, and the ids of a text are
    those of its words, each with the spaces before it; each worker keeps those of the words it has met.
    """

    _words = staticmethod(re.compile(" +[^ ]+").findall)

    def __init__(self, path: str) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self._model.get_piece_size()
        names = [self._model.id_to_piece(k) for k in range(n)]
        is_byte = [self._model.is_byte(k) for k in range(n)]
        control = [self._model.is_control(k) or self._model.is_unknown(k) for k in range(n)]
        self.vocabulary = Vocabulary(
            [
                b"" if c else bytes([int(name[3:5], 16)]) if b else name.replace("▁", " ").encode()
                for name, b, c in zip(names, is_byte, control, strict=True)
            ]
        )
        plain = [x for x, b, c in zip(names, is_byte, control, strict=True) if not (b or c)]
        self._by_word = not any("▁" in x.lstrip("▁") for x in plain)
        self._known = _Words(self._whole)

    def _whole(self, text: str) -> bytes:
        return np.array(self._model.encode(text[1:], num_threads=1), dtype="<u4").tobytes()

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        known = self._known
        if len(known) > MEMORY:
            known.clear()
        out = []
        for text in texts:
            if not self._by_word or text.endswith(" ") or "▁" in text:
                out.append(np.frombuffer(self._whole(text), dtype="<u4"))
                continue
            out.append(np.frombuffer(b"".join(map(known.__getitem__, self._words(text))), dtype="<u4"))
        return out


@dataclass
class Pair:
    """Two tokenizers, and how their ids are written with the sign after them."""

    a: WordEncoder
    a_tokens: Vocabulary
    b: PieceEncoder
    names: list[bytes]

    @classmethod
    def load(cls, path_a: str, path_b: str) -> Pair:
        b = PieceEncoder(path_b)
        a_tokens = _byte_level(path_a)
        most = max(len(a_tokens.sizes), len(b.vocabulary.sizes))
        return cls(WordEncoder(path_a, True), a_tokens, b, [b"%d%c" % (k, sign) for sign in b",|;" for k in range(most)])


_loaded: dict[tuple[str, str], Pair] = {}


def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair per worker and files."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair.load(path_a, path_b)
    return _loaded[path_a, path_b]


@dataclass
class Aligned:
    """Texts of a batch: ids of their tokens, links (places in ``a`` and ``b``, shared bytes), group of every token."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray  # tokens up to the end of each text
    b_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    shared: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    text_of_group: np.ndarray
    n_shared: np.ndarray  # links within a group, by text


def align(texts: list[str | None], pair: Pair) -> Aligned:
    """Tokens, groups and links of each text; none for a missing or empty one, or where the bytes are not kept."""
    spaced = [" " + (t or "") for t in texts]
    data = [s.encode("utf-8", "replace") if len(s) > 1 else b"" for s in spaced]
    a = pair.a.ids(spaced)
    b = pair.b.ids(spaced)
    none = np.zeros(0, dtype="<u4")
    for k, text in enumerate(data):
        whole = np.frombuffer(text, dtype=np.uint8)
        ok = len(text) and all(
            len(x) and v.sizes[x].sum() == len(text) and (v.joined(x) == whole).all()
            for x, v in ((a[k], pair.a_tokens), (b[k], pair.b.vocabulary))
        )
        if not ok:
            a[k] = b[k] = none
    a_ends, b_ends = np.cumsum([len(x) for x in a]), np.cumsum([len(x) for x in b])
    flat_a = np.concatenate([*a, none]).astype(np.int64)
    flat_b = np.concatenate([*b, none]).astype(np.int64)
    bytes_a = Csr.of_runs(pair.a_tokens.sizes[flat_a])
    bytes_b = Csr.of_runs(pair.b.vocabulary.sizes[flat_b])
    link_a, link_b, shared = bytes_a @ bytes_b.transposed()
    ends_a, ends_b = bytes_a.starts[1:], bytes_b.starts[1:]
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    in_group = Csr.of_places(group_a, len(cuts)).sizes(Csr.of_places(group_b, len(cuts)).transposed())
    text_a = np.repeat(np.arange(len(texts)), np.diff(a_ends, prepend=0))
    n_shared = np.bincount(text_a, in_group, len(texts)).astype(np.int64)
    last = np.searchsorted(group_a, np.arange(len(cuts)), side="right") - 1
    return Aligned(flat_a, flat_b, a_ends, b_ends, link_a, link_b, shared, group_a, group_b, text_a[last], n_shared)


def group_digests(found: Aligned, pair: Pair) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; empty without tokens."""
    half = len(pair.names) // 3
    a, b, ga, gb = found.a, found.b, found.group_a, found.group_b
    groups = np.arange(len(found.text_of_group))
    sign_a = np.append(ga[1:] != ga[:-1], True) if len(a) else np.zeros(0, dtype=bool)
    sign_b = np.append(gb[1:] != gb[:-1], True) if len(b) else np.zeros(0, dtype=bool)
    # a group's tokens of A come before its tokens of B
    before_b = np.searchsorted(gb, groups)
    up_to_a = np.searchsorted(ga, groups, side="right")
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + before_b[ga]] = a + sign_a * half
    order[np.arange(len(b)) + up_to_a[gb]] = b + sign_b * 2 * half
    names = list(map(pair.names.__getitem__, order.tolist()))
    ends = (found.a_ends + found.b_ends).tolist()
    out = []
    for start, stop in zip([0, *ends[:-1]], ends, strict=True):
        out.append(hashlib.sha256(b"".join(names[start:stop])[:-1]).hexdigest() if stop > start else "")
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Stretches of ``texts`` of about ``PIECE_BYTES``, one text at least."""
    start = size = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and size + n > PIECE_BYTES:
            yield start, k
            start, size = k, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def _digest_rows(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, the counts and digest of each row, and its different pairs of ids with how often each is linked."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "pairs", "times"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        n_b_ids = len(pair.b.vocabulary.sizes)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _pieces(texts):
                found = align(texts[start:stop], pair)
                rows_of_link = np.searchsorted(found.a_ends, found.link_a, side="right")
                linked = found.a[found.link_a] * n_b_ids + found.b[found.link_b]
                order = np.lexsort((linked, rows_of_link))
                linked, owner = linked[order], rows_of_link[order]
                first = (
                    np.flatnonzero(np.append(True, (linked[1:] != linked[:-1]) | (owner[1:] != owner[:-1])))
                    if len(linked)
                    else np.zeros(0, dtype=np.int64)
                )
                times = np.diff(np.append(first, len(linked)))
                ends = np.searchsorted(owner[first], np.arange(stop - start + 1))
                n = stop - start
                columns = [
                    batch.column(0).slice(start, n),
                    pa.array(np.diff(found.a_ends, prepend=0)),
                    pa.array(np.diff(found.b_ends, prepend=0)),
                    pa.array(np.bincount(found.text_of_group, minlength=n)),
                    pa.array(np.bincount(rows_of_link, minlength=n)),
                    pa.array(found.n_shared),
                    pa.array(group_digests(found, pair)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(linked[first])),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    counts = ", ".join(f"{n} long" for n in names[1:6])
    return rows.mapInArrow(read, f"doc_id {kind}, {counts}, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n, the links between its ids in all rows; tasks add up before they shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(back, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        for batch in batches:
            held.append(tuple(batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2)))
            size += len(held[-1][0])
            if size > PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if 2 * size > PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], names=["pair", "n"])

    parts = rows.select("pairs", "times").mapInArrow(add, "pair long, n long")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(rows: DataFrame, counts: DataFrame, n_b_ids: int) -> DataFrame:
    """``rows`` with n_best and count_sum from ``counts``, which must be small: sorted pairs and counts are broadcast."""
    found = counts.toPandas().sort_values("pair")
    pairs, n = found["pair"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.int64)
    highest = np.zeros(n_b_ids, dtype=np.int64)
    np.maximum.at(highest, pairs % n_b_ids, n)
    sent = rows.sparkSession.sparkContext.broadcast((pairs, n, highest))
    kept = [f for f in rows.schema if f.name not in ("pairs", "times")]
    names = [*[f.name for f in kept], "n_best", "count_sum"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, highest = sent.value
        for batch in batches:
            lists = batch.column(len(kept))
            sizes = np.diff(lists.offsets.to_numpy())
            key = lists.flatten().to_numpy(zero_copy_only=False)
            times = batch.column(len(kept) + 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = n[np.searchsorted(pairs, key)] if len(key) else np.zeros(0, dtype=np.int64)
            best = times * (count == highest[key % n_b_ids])
            totals = [np.append(0, np.cumsum(x)) for x in (best, count * times)]
            ends = np.cumsum(sizes)
            sums = [pa.array(x[ends] - x[ends - sizes]) for x in totals]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *sums], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*[f.name for f in kept], "pairs", "times").mapInArrow(look, f"{schema}, n_best long, count_sum long")


def _joined(rows: DataFrame, counts: DataFrame, n_b_ids: int) -> DataFrame:
    """The same by joins on the pair, for vocabularies that meet in too many pairs to broadcast them."""
    row = free_name(rows, "row")
    numbered = keep(rows.withColumn(row, F.monotonically_increasing_id()), "alignment-rows")
    b = F.col("pair") % n_b_ids
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("highest"))
    judged = counts.withColumn("b", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("is_best"))
    each = numbered.select(row, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(row, "x.pairs", "x.times")
    each = each.withColumnRenamed("pairs", "pair").join(judged, "pair")
    sums = each.groupBy(row).agg(
        F.sum(F.col("times") * F.col("is_best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    whole = numbered.drop("pairs", "times").join(sums, row, "left").drop(row)
    return whole.fillna(0, ["n_best", "count_sum"])


def digests(docs: DataFrame, path_a: str, path_b: str, *, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared of every row.

    ``docs``: doc_id and text, other columns are ignored. A null or empty text has no tokens: zeros and an empty digest, as has one whose
    bytes a tokenizer does not keep. Repeated rows and ids each count. An empty table gives an empty one.
    Pairs of ids and their counts are broadcast up to ``limit`` bytes and joined beyond it.
    """
    rows = keep(_digest_rows(docs, path_a, path_b), "alignment")
    counts = keep(pair_counts(rows), "pair-counts")
    n_b_ids = len(PieceEncoder(path_b).vocabulary.sizes)
    small = counts.count() * PAIR_BYTES <= limit
    found = (_looked_up if small else _joined)(rows, counts, n_b_ids)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared")


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a, b (places of the tokens in their text), a_id, b_id, bytes (shared), same_group: every overlap link."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    names = ["doc_id", "a", "b", "a_id", "b_id", "bytes", "same_group"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _pieces(texts):
                found = align(texts[start:stop], pair)
                text = np.searchsorted(found.a_ends, found.link_a, side="right")
                columns = [
                    batch.column(0).slice(start, stop - start).take(pa.array(text)),
                    pa.array(found.link_a - np.append(0, found.a_ends)[text]),
                    pa.array(found.link_b - np.append(0, found.b_ends)[text]),
                    pa.array(found.a[found.link_a]),
                    pa.array(found.b[found.link_b]),
                    pa.array(found.shared),
                    pa.array(found.group_a[found.link_a] == found.group_b[found.link_b]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(read, f"doc_id {kind}, a long, b long, a_id long, b_id long, bytes long, same_group boolean")
