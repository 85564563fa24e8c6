"""Scores of the quality rules against plain Python."""

import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from poselytics.llm import ngram_ratio


def signed(x):
    return x - 2**64 if x >> 63 else x


def buckets_of(text, n):
    """Buckets of words and neighbouring pairs; a pair's hash goes on from that of its first word's."""
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    number = lambda h: h.to_bytes(8, "little", signed=True)
    pairs = [
        signed(xxhash.xxh64_intdigest(number(b), xxhash.xxh64_intdigest(number(a), 42)))
        for a, b in zip(hashes, hashes[1:], strict=False)
    ]
    return [h % n for h in hashes + pairs]


def brute_scores(rows, good, n, smoothing):
    every, trusted = Counter(), Counter()
    for i, text in rows:
        every.update(buckets_of(text, n))
        if i in good:
            trusted.update(buckets_of(text, n))
    n_all, n_good = sum(every.values()), sum(trusted.values())
    out = []
    for i, text in rows:
        found = buckets_of(text, n)
        own = 1 if i in good else 0
        ratios = [
            math.log((max(trusted[b] - own, 0) + smoothing) / ((every[b] - 1) * n_good / n_all + smoothing)) for b in found
        ]
        out.append((i, sum(ratios) / len(ratios) if ratios else 0.0))
    return out


def test_scores_and_verdicts(llm, docs, texts, labels):
    for n in (64, ngram_ratio.BUCKETS):
        found = ngram_ratio.judge(docs.withColumn("good", F.lit(1)), labels, buckets=n, threshold=-0.05).collect()
        good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["doc_id"] is not None}
        expected = brute_scores(texts, good, n, ngram_ratio.SMOOTHING)
        by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        pairs = list(zip(by_id([(r["doc_id"], r["ngram_score"]) for r in found]), by_id(expected), strict=True))
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in pairs)
        assert all(r["kept"] == (not r["base_failed"] and r["ngram_score"] >= -0.05) for r in found)
        assert len({r["kept"] for r in found if not r["base_failed"]}) == 2 or n == 64


def test_ids_never_meet_texts_in_a_sort(llm, docs, labels):
    """Any number of trusted ids leaves the same plan: texts move once, and only numbers are joined after that."""
    trusted = ngram_ratio.trusted_ids(labels)
    good = docs.select("doc_id", "text").join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")
    assert "ShuffledHashJoin" in good._jdf.queryExecution().executedPlan().toString()
