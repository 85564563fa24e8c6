"""Phrase mining against counts of every run of words, in one group and in many."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from poselytics.llm import phrases


def brute(rows, least, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts["und" if lang is None else lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        found = {p: v for p, v in c.items() if len(p) > 1 and v >= least}
        inside = {
            p[i:j]
            for p, v in found.items()
            for i in range(len(p))
            for j in range(i + 2, len(p) + 1)
            if p[i:j] != p and 100 * v >= 100 * found[p[i:j]]
        }
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, r[2], r[1], r[3], r[4], n, r[0]) for i, r in enumerate(rows[:top])]
    return sorted(out)


def table_rows(texts):
    langs = ["en", "fr", None, "und", "x\ny", ""]
    rows = [(langs[k % 6], t) for k, (_, t) in enumerate(texts)]
    rows += [("en", "the end of the end of The END of it, the end of") for _ in range(30)]
    rows += [("fr", "a " * 700), (None, "\t tab\tand space\x0bcut here\u00a0too. \u2028 ")]
    return rows


@pytest.mark.parametrize("least,top,budget,chunk", [(3, 2000, 1 << 21, 1 << 21), (2, 7, 40, 1 << 21), (5, 100, 300, 500), (100, 2000, 9, 50)])
def test_phrases(llm, texts, monkeypatch, least, top, budget, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rows = table_rows(texts)
    docs = llm.createDataFrame(rows, "lang string, text string").repartition(3)
    docs = docs.withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(0))
    found = phrases.mine(docs, least=least, top=top, budget=budget)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, least, top)


def test_no_phrases(llm, empty):
    assert phrases.mine(empty).count() == 0
    blank = llm.createDataFrame([(None, None), ("en", ""), ("en", " .,! \n")], "lang string, text string")
    assert phrases.mine(blank, least=1).count() == 0


def test_frequent_prefixes_are_extended():
    slots = np.zeros((phrases.DEPTH, 8), dtype=np.int64)
    slots[0] = [5, 50, 5, 5, 0, 0, 0, 0]
    slots[1] = [30, 6, 6, 6, 0, 0, 0, 0]
    slots[4] = 40
    groups = phrases.Partition.of(slots, 10).groups
    assert groups[0, 1] == -1 and groups[1, 0] == -1  # too frequent: one word more
    assert groups[0, 0] == groups[0, 2] != groups[0, 3]  # two fit the budget, a third does not
    assert (groups[4] >= 0).all() and len(set(groups[0]) & set(groups[1]) - {-1}) == 0


def test_scores_past_64_bits(llm):
    big = 10**12
    found = llm.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    totals = llm.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    row = phrases.scored(found, totals).first()
    assert row["score"] == 1000 * (big - 7) * 9 * 10**15 // big**2
