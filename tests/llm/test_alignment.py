"""Alignment of two tokenizers against spans walked token by token."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from poselytics.llm import alignment
from poselytics.llm.queries import BYTES, PIECES

PATHS = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)


def spans(tokens):
    out, place = [], 0
    for k, data in tokens:
        out.append((k, place, place + len(data)))
        place += len(data)
    return out


def token_bytes():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or 174 <= x)]
    back = {chr(x): x for x in range(256) if x not in hidden} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def of_a(text):
        found = a.encode(" " + text, add_special_tokens=False)
        return [(k, bytes(back[c] for c in t)) for k, t in zip(found.ids, found.tokens, strict=True)]

    def of_b(text):
        names = [(k, b.id_to_piece(k)) for k in b.encode(text)]
        return [(k, bytes([int(n[3:5], 16)]) if b.is_byte(k) else n.replace("▁", " ").encode()) for k, n in names]

    return of_a, of_b


def brute(rows):
    of_a, of_b = token_bytes()
    found, count = [], Counter()
    for i, text in rows:
        a, b = (of_a(text), of_b(text)) if text else ([], [])
        if any(b"".join(x for _, x in t) != (" " + (text or "")).encode() for t in (a, b)):
            a, b = [], []
        sa, sb = spans(a), spans(b)
        links, at = [], 0
        for p, s, e in sa:
            while sb[at][2] <= s:
                at += 1
            k = at
            while k < len(sb) and sb[k][1] < e:
                links.append((p, sb[k][0]))
                k += 1
        groups, x, y, shared = [], 0, 0, 0
        for end in sorted({e for _, _, e in sa} & {e for _, _, e in sb}):
            ga = [p for p, _, e in sa[x:] if e <= end] if len(sa) < 200 else []
            while len(sa) >= 200 and x + len(ga) < len(sa) and sa[x + len(ga)][2] <= end:
                ga.append(sa[x + len(ga)][0])
            gb = []
            while y + len(gb) < len(sb) and sb[y + len(gb)][2] <= end:
                gb.append(sb[y + len(gb)][0])
            x, y = x + len(ga), y + len(gb)
            shared += len(ga) * len(gb)
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
        count.update(links)
        found.append((i, a, b, groups, links, shared))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(
        (
            (
                -(10**9) if i is None else i, len(a), len(b), len(g), len(l), sum(count[p] == best[p[1]] for p in l),
                sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", s,
            )
            for i, a, b, g, l, s in found
        )
    )


ODD = [" ", "a  b   c ", "x▁y", "日本語 é🙂 \x01 <s> <|endoftext|> <0x0A>\n\t z\r", "\n\n a\u3000b c ﬁ Å", "  lead", "\x00nul", "x" * 5000, "tail  "]


@pytest.mark.parametrize("limit", [1 << 26, 0])  # counts broadcast, counts joined
def test_digests(llm, docs, texts, empty, limit, monkeypatch):
    rows = [*texts, *((2000 + k, t) for k, t in enumerate(ODD))]
    frame = llm.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("n_a", F.lit(0))
    found = alignment.digests(frame.repartition(3), *PATHS, limit=limit).collect()
    assert sorted((-(10**9) if r[0] is None else r[0], *r[1:]) for r in found) == brute(rows)
    assert alignment.digests(empty, *PATHS, limit=limit).count() == 0


def test_long_batches_are_cut(texts, monkeypatch):
    pair = alignment.pair_of(*PATHS)
    whole = [t for _, t in texts]
    at_once = alignment.group_digests(alignment.align(whole, pair), pair)
    monkeypatch.setattr(alignment, "PIECE_BYTES", 300)
    parts = list(alignment._pieces(whole))
    assert len(parts) > 5
    assert [d for s, e in parts for d in alignment.group_digests(alignment.align(whole[s:e], pair), pair)] == at_once


def test_links(llm):
    text = "Überlegungen  wörtlich tokenization\n"
    rows = alignment.links(llm.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), *PATHS).collect()
    of_a, of_b = token_bytes()
    expected = [
        (1, i, j, p, q, min(e, f) - max(s, r))
        for i, (p, s, e) in enumerate(spans(of_a(text)))
        for j, (q, r, f) in enumerate(spans(of_b(text)))
        if min(e, f) > max(s, r)
    ]
    assert sorted(tuple(r)[:6] for r in rows) == expected
    assert all(r["same_group"] for r in rows)  # tokens that share bytes never lie in different groups


def dense(m):
    out = np.zeros((m.height, m.width), dtype=int)
    out[np.repeat(np.arange(m.height), np.diff(m.starts)), m.columns] = 1
    return out


@pytest.mark.parametrize("seed", range(5))
def test_product_against_dense(seed):
    rng = np.random.default_rng(seed)

    def matrix(n, width):
        rows = [np.flatnonzero(rng.random(width) < 0.4) for _ in range(n)]
        return alignment.Csr(np.cumsum([0, *map(len, rows)]), np.concatenate([*rows, np.zeros(0, int)]).astype(int), width)

    a, b = matrix(6, 9), matrix(7, 9)
    row, column, value = a @ b.transposed()
    product = np.zeros((6, 7), dtype=int)
    product[row, column] = value
    assert (product == dense(a) @ dense(b).T).all() and (value > 0).all()
    assert (a.sizes(b.transposed()) == (dense(a) @ dense(b).T).sum(axis=1)).all()
    assert (dense(b.transposed()) == dense(b).T).all()
