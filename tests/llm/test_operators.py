"""Every operator against a brute-force version, on awkward rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from poselytics.llm import (
    bitplanes,
    decontaminate,
    gam,
    line_dedup,
    ngram_ratio,
    packing,
    simhash,
    skip_chain,
    span_dedup,
    templates,
)
from poselytics.llm.queries import BYTES, WORDS
from tests.llm.conftest import prose


def encoded(name, end, text):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=repr)


# 1


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 49408, n).astype("<u4")
    assert (bitplanes.from_planes(bitplanes.to_planes(ids, 16, unit), n, unit) == ids).all()


def test_planes_refuse_large_ids():
    with pytest.raises(ValueError):
        bitplanes.to_planes(np.array([70_000], dtype="<u4"), 16)


@pytest.mark.parametrize("block,unit", [(1000, 1), (1 << 16, 8)])
def test_ids_written_and_read(llm, docs, texts, tmp_path, block, unit):
    path = str(tmp_path / "ids")
    bitplanes.write_ids(docs.withColumn("row", F.lit(1)), path, public_tokenizers.path(WORDS), 1, block_ids=block, unit=unit)
    rows = sorted(bitplanes.read_digests(llm, path).collect(), key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(-1 if i is None else i for i, _ in texts)
    start, found = 0, Counter()
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
        found[r["doc_id"], r["n_tokens"], r["ids_crc32"]] += 1
    expected = [(i, encoded(WORDS, 1, t)) for i, t in texts]
    assert found == Counter((i, len(e), zlib.crc32(e.tobytes())) for i, e in expected)
    index = bitplanes.read_index(llm, path).orderBy("first").collect()
    assert sum(r["n_ids"] for r in index) == start
    assert all(r["n_ids"] <= block for r in index)


def test_ids_of_nothing(llm, empty, tmp_path):
    bitplanes.write_ids(empty, str(tmp_path / "ids"), public_tokenizers.path(WORDS), 1)
    assert bitplanes.read_digests(llm, str(tmp_path / "ids")).count() == 0


# 2

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>One<li>Two</ul></nav>
<div class="cookie-notice">We use</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text<p>Second&nbsp;one<div class="promo">Buy</div><form>Mail</form></article><section id="comments"><p>Nice!</p></section>
<div>{block}</div><footer>&copy; x</footer>"""


def test_main_text():
    text = lambda page: templates.main_text(templates.parse(page))
    assert text(PAGE) == "Head & line First bold text Second one"
    assert text("") == text(None) == ""
    assert text("a<script>if (a<b) x('</p>')</script>b<!-- c --> <p hidden>d</p>e <b") == "ab e"
    assert text("<main>m</main><p>o") == "m"
    assert text("<p>1</div>2</p>3") == "1 2 3" or text("<p>1</div>2</p>3") == "12 3"
    assert text("<div>" * 3000 + "deep") == "deep"
    # a value may end in a slash, and a slash closes no element of HTML
    assert text("<article data-u=/x/><p>Here</p></article><p>o") == "Here"
    assert text("<article><div/><p>One</p></article>") == "One"
    assert text("<article>a <svg><path d='1'/><g/></svg>b</article>") == "a b"
    # one word of several names no part of a site
    for name in ("share-price-table", "related-work", "notice-period", "comment_count_by_year"):
        assert text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a b"
    for name in ("share-buttons", "ad-box", "related-posts", "site-footer", "promo", "cookie_notice"):
        assert text(f"<article><p>a</p><div class='{name}'>b</div></article>") == "a"
    assert len(text("<p>word</p>" * 200_000).split()) == 200_000


def test_templates_go_before_the_main_element_is_chosen():
    teaser = "<div><article><p>Teaser of every page</p></article></div>"
    root = templates.parse(f"<body>{teaser}<div><p>Text of <b>this</b> page</p></div><ul><li>More</ul></body>")
    templates.hash_tree(root, "h")
    other = templates.parse(f"<body><p>x</p>{teaser}<ul><li>More</ul></body>")
    templates.hash_tree(other, "h")
    assert templates.main_text(root) == "Teaser of every page"
    shared = {n.hash for n in templates.blocks(root)} & {n.hash for n in templates.blocks(other)}
    assert templates.delete_templates(root, lambda n: n.hash in shared) == 2
    assert templates.main_text(root) == "Text of this page"


def test_templates_decide_pages_without_marks(llm):
    """Text, menu and teasers are all plain divisions; a host's many pages tell them apart, by brute force too."""
    menu, teaser = "<div><p>Home</p><p>Shop</p></div>", "<div><article><p>Offer of the week</p></article></div>"
    rows = [(k, f"http://{k % 2}.example.com/{k}", f"{menu}<div><p>{prose(k, 30)}</p></div>{teaser}") for k in range(60)]
    # one more page of a large host has a block that only nine others share
    rows += [(100 + k, f"http://0.example.com/x{k}", f"<div>Nine times</div><p>{prose(200 + k, 30)}</p>") for k in range(9)]
    found = {r["page_id"]: r["text"] for r in templates.extract(llm.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(60):
        assert found[k] == " ".join(prose(k, 30).split())
    for k in range(9):
        assert found[100 + k] == "Nine times " + " ".join(prose(200 + k, 30).split())


def test_site_templates(llm):
    rows = [(k, f"http://Big.example.com/{k}", f"<div>Read our other stories</div><p>{prose(k, 40)}</p>") for k in range(30)]
    copy = f"<div>Read our other stories</div><p>{prose(99, 40)}</p>"
    rows += [(100 + k, "http://big.example.com/c", copy) for k in range(40)]  # copies are no template
    rows += [(200, "http://small.example.com/", "<div>Read our other stories</div><p>x</p>"), (201, None, None), (201, "u", "")]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for limit in (1 << 20, 4):  # in one group of hosts and in several
        found = {(r["page_id"], r["url"]): r["text"] for r in templates.extract(pages, limit=limit).collect()}
        assert len(found) == len({r[:2] for r in rows})
        for k in range(30):
            assert found[k, f"http://Big.example.com/{k}"] == " ".join(prose(k, 40).split())
        assert found[100, "http://big.example.com/c"] == " ".join(prose(99, 40).split())
        assert found[200, "http://small.example.com/"] == "Read our other stories x"
        assert found[201, None] == ""
    assert templates.extract(pages.limit(0)).count() == 0


# 3


def test_best_fit_against_scan():
    rng = np.random.default_rng(1)
    for _ in range(200):
        lengths = rng.integers(1, 21, rng.integers(0, 50)).tolist()
        bins, offsets, used = packing.best_fit(lengths, 20)
        rooms: list[int] = []
        for length in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms[rooms.index(min(fits))] -= length
            else:
                rooms.append(20 - length)
        assert used == len(rooms)
        filled = defaultdict(list)
        for length, b, o in zip(lengths, bins, offsets, strict=True):
            filled[b].append((o, length))
        for pieces in filled.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 20


def test_pack(docs, texts, empty):
    rows = packing.pack(docs.withColumn("row", F.lit("clash")), public_tokenizers.path(BYTES), 2, group=10).collect()
    expected = Counter()
    for i, text in texts:
        ids = encoded(BYTES, 2, text)
        for piece, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected[i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == expected
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in filled.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(empty, public_tokenizers.path(BYTES), 2).count() == 0


# 4

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and skip_chain.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = np.random.default_rng(2)
    letters = "a.b@c-1234 5+()_%9\n"
    for _ in range(5000):
        text = "".join(letters[k] for k in rng.integers(0, len(letters), 40))
        assert skip_chain.base_spans(text) == brute_spans(text)


def test_skip_edges_carry_labels():
    width = len(skip_chain.KINDS) + 1
    node = np.zeros((skip_chain.N_FEATURES + 1, width))
    node[20, 3] = 6.0  # digits only: a card
    g = skip_chain.graph("see 4111111111111111 there and (4111111111111111) again")
    assert g.skip == [(0, 1)] and not g.chain
    field = skip_chain.Field(node, np.zeros((width, width)), 4 * np.eye(width))
    assert (field.marginals(g).argmax(axis=1) == 3).all()
    alone = skip_chain.Field(node, np.zeros((width, width)), np.zeros((width, width)))
    assert alone.marginals(g)[1].max() < field.marginals(g)[1].max()


def test_marginals_on_a_chain_are_exact():
    rng = np.random.default_rng(3)
    width = len(skip_chain.KINDS) + 1
    g = skip_chain.graph("1 22 333")
    assert g.chain == [(0, 1), (1, 2)]
    field = skip_chain.Field(rng.normal(size=(skip_chain.N_FEATURES + 1, width)), rng.normal(size=(width, width)), np.zeros((width, width)))
    bits = np.array([[(s >> k) & 1 for k in range(skip_chain.N_FEATURES)] + [1] for s in g.shapes])
    own = bits @ field.node
    joint = np.exp(
        own[0][:, None, None] + own[1][None, :, None] + own[2] + field.chain[:, :, None] + field.chain[None, :, :]
    )
    joint /= joint.sum()
    exact = np.stack([joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))])
    assert np.abs(field.marginals(g) - exact).max() < 1e-3


def test_find(docs, texts, empty):
    rows = skip_chain.find(docs.withColumn("spans", F.lit(3))).collect()
    as_text = lambda spans: ",".join(f"{skip_chain.KINDS[k]}:{a}:{b}" for a, b, k in spans)
    assert ordered((r["doc_id"], r["base_sha256"]) for r in rows) == ordered((i, sha(as_text(brute_spans(t)))) for i, t in texts)
    for r in rows:
        base = brute_spans(r["text"])
        assert set(filter(None, as_text(base).split(","))) <= set(r["spans"].split(","))
        assert [r[f"n_{k}"] for k in skip_chain.KINDS] == [sum(s[2] == n for s in base) for n in range(4)]
    assert skip_chain.find(empty).count() == 0


KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def personal(k):
    """A text with a phone, a card, an address, a secret, decoys, and mentions of some that no pattern finds."""
    return (
        f"write to ann{k}@mail.example.com or call +1 (38{k % 10}) 555-37{k % 90 + 10} from 10.2.{k % 250}.7\n"
        f"pay with 4111 1111 1111 1111 today, order 98079157628044{k % 90 + 10}\n"
        f'api_key = "{KEY[:-2]}{k % 90 + 10}" and commit {KEY[2:]}{k % 90 + 10} of version 1.{k}\n'
    )


def test_field_adds_secrets_and_mentions_but_no_decoys(llm):
    extra = "later {0} was used again, and 555-3755 called, not 555-9999 or 4111 alone; Password: hunter2hunter2hunter2"
    texts = {k: personal(k) for k in range(80)} | {100: personal(45) + extra.format(KEY[:-2] + "55"), 101: "token=abc", 102: ""}
    texts[103] = "+1 (826) 555-4081 190.137.223.46"  # the pattern takes too many digits
    found = {
        r["doc_id"]: set(filter(None, r["spans"].split(",")))
        for r in skip_chain.find(llm.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    }
    as_text = lambda spans: {f"{skip_chain.KINDS[k]}:{a}:{b}" for a, b, k in spans}
    more = {i: {(s.split(":")[0], texts[i][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in spans - as_text(brute_spans(texts[i]))} for i, spans in found.items()}
    for k in range(80):
        assert more[k] == {("secret", f"{KEY[:-2]}{k % 90 + 10}")}
    assert more[100] == {("secret", KEY[:-2] + "55"), ("secret", "hunter2hunter2hunter2"), ("phone", "555-3755")}
    assert not more[101] and not more[102]
    assert more[103] == {("phone", "+1 (826) 555-4081")}


def test_skip_edges_find_what_they_alone_can(llm):
    rows = [(k, personal(k)) for k in range(80)]
    field = skip_chain.fit(llm.createDataFrame(rows, "doc_id long, text string"))
    alone = skip_chain.Field(field.node, field.chain, np.zeros_like(field.skip))
    text = personal(45) + f"later {KEY[:-2]}55 was used again"
    base = skip_chain.base_spans(text)
    last = (len(text) - 55, len(text) - 15)
    assert text[slice(*last)] == KEY[:-2] + "55"
    assert (*last, skip_chain.SECRET) in skip_chain.more_spans(text, base, field)
    g = skip_chain.graph(text)
    at = g.spots.index(last)
    known = skip_chain.marks(g, base)
    assert known[at] == 0
    assert alone.marginals(g, known)[at, 1 + skip_chain.SECRET] < field.marginals(g, known)[at, 1 + skip_chain.SECRET]


def test_long_tokens_take_linear_time():
    text = "1" * 200_000 + "@" * 1000 + "a" * 200_000
    assert skip_chain.base_spans(text) == []
    assert len(skip_chain.tokens("a" * 300_000 + " 1")) == 1


# 5


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    values = sorted(set(prints))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    return {v: root(v) for v in values}


def test_near_duplicates(docs, texts, empty):
    prints = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(prints, 4)
    least = {}
    for (i, _), p in zip(texts, prints, strict=True):
        if i is not None:
            least[roots[p]] = min(i, least.get(roots[p], i))
    rows = simhash.near_duplicates(docs).collect()
    found = ordered((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows)
    assert found == ordered((i, p, least.get(roots[p])) for (i, _), p in zip(texts, prints, strict=True))
    kept = [r["doc_id"] for r in simhash.deduplicate(docs.withColumn("row", F.lit(0))).collect()]
    nameless = {r for r in roots.values() if r not in least}
    assert ordered(kept) == ordered([*least.values(), *[None] * len(nameless)])
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("limit,block", [(2, 8192), (16, 8192), (512, 8192), (2, 3), (16, 20)])
def test_links_survive_cutting_shards(llm, limit, block):
    rng = np.random.default_rng(limit)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    values = set(base.tolist())
    for v in base.tolist():  # chains of near values
        for _ in range(40):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                v ^= 1 << int(b)
            values.add(v)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    prints = llm.createDataFrame([(v,) for v in signed], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.link(prints, 4, limit, block).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in pairs)
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        parent[root(a)] = root(b)
    expected = brute_components(values, 4)
    groups = lambda of: {frozenset(v for v in values if of(v) == r) for r in {of(v) for v in values}}
    assert groups(root) == groups(expected.get)


# 6


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + d for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for d in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules(llm, docs, texts, labels, empty):
    odd = ["a b c a b c", "a a a a a", "x y z", "a b a b a b a", "#*$ <| %&>\n#*$ <| %&>\n\n\n", "p q r s " * 60]
    more = llm.createDataFrame([(900 + k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    every = docs.withColumn("n_words", F.lit("clash")).select("doc_id", "text").union(more)
    rows = ngram_ratio.judge(every, labels).collect()
    found = ordered((r["doc_id"], *[r[c] for c in ngram_ratio.RULES]) for r in rows)
    assert found == ordered((i, *brute_rules(t)) for i, t in [*texts, *[(900 + k, t) for k, t in enumerate(odd)]])
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert ngram_ratio.judge(empty, labels).count() == 0
    assert ngram_ratio.judge(docs, labels.limit(0)).count() == len(texts)


def test_rules_need_no_python(docs, labels):
    plan = ngram_ratio.judge(docs, labels)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


# 7


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in [tuple(sorted(p[:2])) for p in model.pairs]
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_classify(docs, texts, labels, empty):
    model = gam.train(docs, labels)
    rows = gam.classify(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    nothing = gam.train(docs, labels.limit(0))
    assert {r["score"] for r in gam.classify(docs, nothing).collect()} == {0.5}
    assert gam.classify(empty, model).count() == 0


def test_held_out_accuracy(llm):
    read = lambda t: llm.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    model = gam.train(read("documents"), read("labels"))
    scored = gam.classify(read("documents"), model).where("held_out").join(read("labels"), "doc_id")
    right = scored.where("predicted = quality").count()
    assert right >= 0.95 * scored.count()


# 8


def brute_lines(texts, least):
    keys = [[x.strip(" \t\n\v\f\r") for x in (t or "").split("\n")] for _, t in texts]
    keys = [[re.sub("[A-Z]", lambda m: m[0].lower(), k) for k in doc] for doc in keys]
    shared = Counter(k for doc in keys for k in set(doc) if k)
    out = []
    for (i, t), doc in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, doc, strict=True) if shared[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return ordered(out)


def applied(index, docs):
    return ordered((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"] or "")) for r in index.apply(docs).collect())


@pytest.mark.parametrize("least", [2, 10])
def test_lines(docs, texts, empty, least, monkeypatch):
    clash = docs.withColumn("n_lines", F.lit(None))
    index = line_dedup.LineIndex.build(clash, least)
    assert applied(index, clash) == brute_lines(texts, least)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    assert applied(index, clash) == brute_lines(texts, least)
    monkeypatch.undo()
    assert line_dedup.LineIndex.build(empty).apply(empty).count() == 0


def test_lines_are_reversible(llm, docs, texts):
    more = [(700 + k, f"Shared line here\nfresh {k % 2}\n{prose(k, 12)}") for k in range(30)]
    extra = llm.createDataFrame(more, "doc_id long, text string")
    base = docs.select("doc_id", "text")
    index = line_dedup.LineIndex.build(base)
    grown = index.add(extra)
    both = base.union(extra)
    assert applied(grown, both) == brute_lines([*texts, *more], 10)
    back = grown.delete(extra)
    assert applied(back, base) == brute_lines(texts, 10)
    assert ordered(map(tuple, back.refs.collect())) == ordered(map(tuple, index.refs.collect()))


def test_cuckoo_filter():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 2**64, (4000, 2), dtype=np.uint64)
    made = line_dedup.CuckooFilter.of(keys[:2000])
    assert made.contains(keys[:2000]).all()
    assert made.contains(keys[2000:]).mean() < 0.01
    made.delete(keys[:1000])
    again = line_dedup.CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(keys[1000:2000]).all() and again.contains(keys[:1000]).mean() < 0.01


# 9


def brute_sentences(text):
    """Sentences as lists of words, cut by the rules of the operator one word at a time."""
    out = []
    for line in (text or "").encode().lower().split(b"\n"):
        words, here = re.findall(rb"[^ \t\n\x0b\x0c\r]+", line), []
        for k, w in enumerate(words):
            here.append(w)
            if w[-1:] in (b".", b"!", b"?") or k == len(words) - 1:
                out += brute_pieces(here)
                here = []
    return out


def brute_pieces(words):
    if len(words) <= span_dedup.LONG:
        return [words]
    base, other, full = int(span_dedup._BASES[0]), int(span_dedup._BASES[1]), 2**64

    def mark(word):
        if len(word) > span_dedup.LONG_WORD:
            return xxhash.xxh3_128_intdigest(word) % full
        h = sum(xxhash.xxh64_intdigest(bytes([b]), 1) * pow(other, i, full) for i, b in enumerate(word)) % full
        h = (h ^ h >> 32) * base % full
        return h ^ h >> 29

    grams = {}
    for k in range(2, len(words)):
        g = ((mark(words[k]) * base + mark(words[k - 1])) * base + mark(words[k - 2])) % full
        grams[k] = g ^ g >> 31
    out, here = [], []
    for k, w in enumerate(words):
        here.append(w)
        if k == len(words) - 1 or (k in grams and grams[k] == min(grams[j] for j in range(k - 3, k + 4) if j in grams)):
            out.append(here)
            here = []
    return out


def brute_removed(texts):
    """Sentences that go: equal runs are found by their words, not by hashes."""
    found = defaultdict(list)
    for i, text in dict.fromkeys(texts):
        twin = xxhash.xxh64_intdigest((text or "").encode(), 42)
        place = (i is None, i or 0, twin - 2**64 if twin >> 63 else twin)
        parts = brute_sentences(text)
        length = lambda a, b: sum(map(len, parts[a:b]))  # noqa: B023, E731
        ok = lambda a, b: b - a >= 2 and length(a, b) >= 15  # noqa: B023, E731
        spans = set()
        for k in range(len(parts)):
            spans |= set([(k, b) for b in range(k + 1, len(parts) + 1) if ok(k, b)][:1])
            spans |= set([(a, k + 1) for a in range(k, -1, -1) if ok(a, k + 1)][:1])
        if parts and not any(a == 0 for a, _ in spans):
            spans.add((0, len(parts)))
        for start, stop in spans:
            found[b" ".join(w for p in parts[start:stop] for w in p)].append((*place, start, stop, i, text))
    gone = defaultdict(set)
    for places in found.values():
        for *_, start, stop, i, text in sorted(places, key=lambda p: p[:5])[1:]:
            gone[i, text].update(range(start, stop))
    return ordered((i, len(gone[i, t])) for i, t in texts)


def test_spans(docs, texts, empty):
    rows = span_dedup.deduplicate(docs.withColumn("twin", F.lit(1)).withColumn("n_removed", F.lit("x"))).collect()
    assert ordered((r["doc_id"], r["n_removed"]) for r in rows) == brute_removed(texts)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[301]["text"] == "" and by_id[301]["n_removed"] == by_id[301]["n_sentences"]
    assert span_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize(("block", "long_word"), [(1 << 18, 1 << 16), (64, 12), (1, 1)])
def test_cuts(monkeypatch, block, long_word):
    """Sentences and equal runs, as words tell them, whatever the blocks in which words are hashed."""
    monkeypatch.setattr(span_dedup, "BLOCK", block)
    monkeypatch.setattr(span_dedup, "LONG_WORD", long_word)
    pick = random.Random(5)
    words = ["Tell", "tell", "us.", "ÄRGER", "ärger", "of\u2028it", "x" * 30, "X" * 30, "", "why?", "\x1c", "no\x00"]
    white = [" ", "  ", "\t", "\x0b", "\r\n", "\n\n", " " * 90]
    texts = ["", " \n ", "one", "\none\n", prose(3, 400), f"so {prose(3, 400)} A{prose(3, 60)}"]
    texts += ["".join(pick.choice(words) + pick.choices(white, [20, 1, 1, 1, 1, 1, 1])[0] for _ in range(n)) for n in (5, 40, 300)]
    found = span_dedup.cut([t.encode() for t in texts])
    sizes = np.diff(found.words)
    equal = defaultdict(set)
    for k, text in enumerate(texts):
        parts = brute_sentences(text)
        assert sizes[found.firsts[k] : found.firsts[k + 1]].tolist() == [len(p) for p in parts]
        for start, stop, (a, b) in zip(found.start - found.firsts[k], found.stop - found.firsts[k], found.hashes.tolist(), strict=True):
            if 0 <= start and stop <= len(parts):
                equal[a, b].add(b" ".join(w for p in parts[start:stop] for w in p))
    assert all(len(runs) == 1 for runs in equal.values())
    assert len(equal) == len({run for runs in equal.values() for run in runs})
    keys = list(zip(found.start.tolist(), found.stop.tolist(), strict=True))
    assert len(keys) == len(set(keys))


def test_passage_goes_and_the_rest_stays(llm):
    passage = "Once more we tell it here. All of it, from the start to the end, in the very same words. And then, as before, nobody listens to us."
    rows = [(k, f"{prose(k, 50)}. {passage}\n{prose(k + 50, 40)}") for k in range(3)]
    found = {r["doc_id"]: r for r in span_dedup.deduplicate(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert passage in found[0]["text"]
    for k in (1, 2):
        assert "nobody listens" not in found[k]["text"] and "very same words" not in found[k]["text"]
        assert found[k]["n_removed"] == 3 and prose(k + 50, 40).split()[-1] in found[k]["text"]


# 10


def brute_hits(text, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    mine, hit, names = words(text), set(), set()
    for name, item in items:
        theirs = words(item)
        n = min(size, len(theirs))
        grams = {tuple(theirs[k : k + n]) for k in range(len(theirs) - n + 1)} if n else set()
        for k in range(len(mine) - n + 1):
            if tuple(mine[k : k + n]) in grams:
                hit.update(range(k, k + n))
                names.add(str(name))
    return len(mine), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)


@pytest.mark.parametrize("limit", [1 << 20, 200])
def test_decontamination(llm, docs, texts, empty, limit, monkeypatch):
    loaded = []
    load = decontaminate._load
    monkeypatch.setattr(decontaminate, "_load", lambda *a: loaded.append(1) or load(*a))
    long = prose(5, 205).upper()
    items = [(1, long), (10, "日本語"), (2, prose(8, 30)), (3, None), (4, " ,. "), (5, "geese1x999"), (2, prose(9, 12))]
    bench = llm.createDataFrame(items, "item_id long, text string")
    clash = docs.withColumn("hits", F.lit(0))
    rows = decontaminate.scan(clash, bench, limit=limit).collect()
    assert len(loaded) == (limit > 200)  # a large benchmark is joined: none of its windows is sent
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert ordered((r["doc_id"], *[r[c] for c in columns]) for r in rows) == ordered((i, *brute_hits(t, items)) for i, t in texts)
    cleaned = decontaminate.scan(docs, bench, remove="spans", limit=limit).collect()
    assert {r["text"] for r in decontaminate.scan(docs.select("doc_id", "text"), bench.limit(0)).collect()} == {t for _, t in texts}
    for before, after in zip(sorted(rows, key=repr), sorted(cleaned, key=repr), strict=True):
        assert before["n_words"] == after["n_words"]
    assert any(r["contaminated"] and "日本語" not in (r["text"] or "") for r in cleaned)
    assert decontaminate.scan(empty, bench, limit=limit).count() == 0
