"""What a review found to be done in part only."""

from pyspark.sql import functions as F

from poselytics.llm import ngram_ratio, span_dedup, templates
from tests.llm.conftest import prose


def left_of(llm, rows):
    found = span_dedup.deduplicate(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: r["text"] for r in found}


def test_passage_that_ends_inside_a_line(llm):
    passage = "Once more we tell it here to all of you now. All of it from the start to the very end again. Nobody listens."
    left = left_of(llm, [(k, f"{prose(k, 50)}. {passage} {prose(k + 50, 40)}") for k in range(3)])
    assert passage in left[0]
    assert all("Nobody listens" not in left[k] and prose(k + 50, 40).split()[-1] in left[k] for k in (1, 2))


def test_passage_inside_a_long_sentence(llm):
    words = " ".join(prose(90, 60).replace(".", "").split())
    rows = [(k, f"{' '.join(prose(k, 11 + 5 * k).replace('.', '').split())} {words} {prose(k + 50, 40)}") for k in range(6)]
    left = left_of(llm, rows)
    shared = words.split()
    assert words in left[0]
    for k in range(1, 6):
        assert sum(w in left[k].split() for w in shared[10:-10]) < 15
        assert not any(" ".join(shared[n : n + 30]) in left[k] for n in range(31))


def test_all_trusted_documents_count(llm):
    rows = [(k, f"good{k % 7} words{k % 11} here") for k in range(21_000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.range(21_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    trusted = ngram_ratio.trusted_ids(labels.union(labels))
    assert trusted.count() == 21_000
    found = ngram_ratio.weights(docs, trusted).collect()
    # each text is trusted, so nothing tells trusted texts from all
    assert found and all(abs(r["other"] - r["own"]) < 1e-2 and abs(r["own"]) < 1e-9 for r in found)


def test_wrappers_of_the_article_are_no_notices():
    read = lambda page: templates.main_text(templates.parse(page))
    article = "<article><p>The text of it.</p><div class='ad-box'>Buy</div></article>"
    for wrapper in ("<div class='layout has-sidebar'>", "<div id='page' class='with-comments'>", "<div class='social'>"):
        assert read(f"<body>{wrapper}{article}<div class='sidebar'>Links</div></div></body>") == "The text of it."
        assert read(f"<body>{wrapper}<main><p>Main part.</p></main></div></body>") == "Main part."
    assert read(f"<body><main><div class='has-sidebar'>{article}</div></main></body>") == "The text of it."
    assert read(f"<body>{article}<div class='related'><article>Teaser</article></div></body>") == "The text of it."
    assert read(f"<body>{article}<div hidden>{article}</div></body>") == "The text of it."
