"""Registered queries against their SQL, and the pipeline against its stages done by hand."""

import zlib

import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from poselytics.llm import gam, line_dedup
from poselytics.llm.queries import BYTES, ORACLES, QUERIES
from tests.compare import difference, duck, rows
from tests.conftest import SMALL
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_hits, brute_lines, encoded


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    found = duck(SMALL).execute(ORACLES[name])
    expected = pd.DataFrame(found.fetchall(), columns=[d[0] for d in found.description], dtype=object)
    assert difference(rows(QUERIES[name](spark, SMALL)), expected) is None


def test_pipeline(llm):
    read = lambda t: llm.read.parquet(f"{SMALL}/{t}.parquet")
    docs, labels, items = read("documents"), read("labels"), [tuple(r) for r in read("benchmark").collect()]
    scored = gam.classify(docs, gam.train(docs, labels)).where("predicted = 1").collect()
    texts = [(r["doc_id"], r["text"]) for r in scored]
    shared = {k for k in _common(texts)}
    texts = [(i, "\n".join(x for x, k in zip(t.split("\n"), line_dedup.keys_of(t), strict=True) if k not in shared)) for i, t in texts]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    roots = brute_components(prints.values(), 4)
    least: dict[int, int] = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    texts = [(i, t) for i, t in texts if least[roots[prints[i]]] == i]
    expected = {}
    for i, t in texts:
        if not brute_hits(t, items)[1]:
            ids = encoded(BYTES, 2, t)
            expected[i] = (len(ids), zlib.crc32(ids[len(ids) - len(ids) % 1024 or 0 :].tobytes()))
    result = corpus_pipeline.run(llm, SMALL).toPandas()
    assert set(result["doc_id"]) == {i for i, _ in texts}
    lengths = result.groupby("doc_id")["length"].sum()
    assert all(lengths[i] == n for i, (n, _) in expected.items())
    assert public_tokenizers.path(BYTES) and brute_lines([(1, "a")], 10)


def _common(texts):
    counts: dict[bytes, int] = {}
    for _, t in texts:
        for k in set(line_dedup.keys_of(t)) - {b""}:
            counts[k] = counts.get(k, 0) + 1
    return [k for k, n in counts.items() if n >= line_dedup.MIN_DOCS]


def test_stages_keep_the_columns(llm):
    docs = llm.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(llm, docs, SMALL).columns == docs.columns
