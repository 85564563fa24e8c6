"""Personal data: fixed patterns, and a skip-chain conditional random field around them.

The patterns give the base spans. The field labels the tokens that could be personal
data at all, those with a digit or an at sign; every other token is outside by
definition, so chains are runs of such tokens. A token's label depends on its
shape, on its neighbour in the run, and, through skip edges, on the other
tokens of the document with the same digits or letters: repeated and similar tokens get the same label.
Sum-product messages are passed along both kinds of edges until they settle; what a base span touches, and a secret
behind a key word, is observed, and all mentions share the potential of that word. A fifth label is that of secrets: keys, tokens and passwords with a digit.

Runs of tokens of one label that the field is sure of and no base span touches become further spans if
their text bears the label out: it passes the kind's own check (digits of a phone or card, Luhn, a
key word before a secret), or it is another mention of something that does, in part or whole.

Potentials are fitted piecewise to the base spans and the secrets behind key words of all documents, from counts that Spark
sums up: label counts of each combination of shape features, and of the two ends
of each kind of edge.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poselytics.llm.common import text_of, without

KINDS = ["email", "ip", "card", "phone"]
#: What the field tells apart: the kinds of the patterns, and secrets.
LABELS = [*KINDS, "secret"]
SECRET = LABELS.index("secret")
#: Least marginal probability of the tokens of a further span; its text must bear it out besides.
SURE = 0.5
#: Log odds of an observed label.
OBSERVED = 30.0
#: Digits that another mention of a phone or card has at least.
MENTION = {KINDS.index("phone"): 7, KINDS.index("card"): 12}
#: Rounds of messages; fewer if nothing moves any more.
ROUNDS = 30
#: Share of a message that is kept from the round before, which steadies loops.
DAMPING = 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# not after a digit: a run of digits matches from its start on or not at all
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_CANDIDATE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")

# Words that announce a secret, followed by a sign of equality (or, for one, a space).
_KEYED = re.compile(
    r"(?:(?:api|access|secret|private|auth|encryption|signing)[ _-]?key|token|secret|passw(?:or)?d|passphrase|pwd|credentials?)"
    r"[\"'`]?[ \t]*(?::=|=>|=|:)[ \t]*[\"'`]?\Z|\bbearer[ \t]+[\"'`]?\Z",
    re.I,
)
#: Characters before a token that are looked at for such a word; longer gaps announce nothing.
_REACH = 40
_SECRET = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}+")
_HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})")
_NAMED = re.compile(r"[A-Za-z_-]++(?:=|:(?!//))")

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), 0
            done = domain.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[Span]:
    """Matches of the four patterns that pass their checks, by start and kind."""
    text = text or ""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                    found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def tokens(text: str) -> list[tuple[int, int]]:
    """Start and end of each token with a digit or an at sign, without marks around it or ``name=`` before it."""
    found = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        named = _NAMED.match(text, start, end)
        if named and named.end() < end:
            start = named.end()
        while start < end and text[start] in "\"'`<[{;:,!?*#$%&|=":
            start += 1
        while end > start and text[end - 1] in "\"'`>]};:,.!?*#$%&|=":
            end -= 1
        if end > start:
            found.append((start, end))
    return found


def is_secret(word: str) -> bool:
    """Whether a token looks like a key: 16 characters or more, letters and digits mixed."""
    return len(word) >= 16 and bool(_SECRET.fullmatch(word)) and bool(_DIGIT.search(word)) and any(c.isalpha() for c in word)


def is_keyed(text: str, start: int) -> bool:
    """Whether a key word announces what begins at ``start``."""
    return bool(_KEYED.search(text, max(0, start - _REACH), start))


def shape(word: str, keyed: bool = False) -> int:
    """Features of a token as bits; ``keyed``: a key word stands before it."""
    digits = sum(c in "0123456789" for c in word)
    letters = sum(c.isalpha() for c in word)
    dots, at = word.count("."), word.count("@")
    parts = word.split(".")
    numbers = [p for p in parts if p.isascii() and p.isdigit()]
    quad = len(parts) == len(numbers) == 4
    flags = [
        at == 1,
        at > 1,
        at == 1 and "." in word.rpartition("@")[2],
        at == 1 and not word.startswith("@"),
        word.startswith("+"),
        word.startswith("(") and word.endswith(")"),
        letters > 0,
        letters > digits,
        digits == 0,
        1 <= digits <= 2,
        3 <= digits <= 4,
        5 <= digits <= 8,
        9 <= digits <= 12,
        13 <= digits <= 19,
        digits > 19,
        "-" in word[1:-1],
        dots == 1,
        dots == 3,
        quad,
        quad and all(len(p) <= 3 for p in parts),
        digits == len(word),
        any(c in "=\"'/\\#" for c in word),
        word.isupper(),
        keyed,
        is_secret(word),
        bool(_HEX.fullmatch(word)),
    ]
    return sum(1 << k for k, flag in enumerate(flags) if flag)


N_FEATURES = 26


@dataclass
class Graph:
    """A document's tokens, chain edges and skip edges; ``alike``: the first token each is tied to, over any number of ties."""

    spots: list[tuple[int, int]]
    shapes: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    alike: list[int]
    keyed: list[bool]


def graph(text: str) -> Graph:
    """Neighbours in a run form chains; each token is tied to the last one like it before.

    Like: the same letters and digits, case and marks aside, or the same four or more digits. As
    many skip edges as tokens at most, however often one repeats: its mentions form a path.
    """
    spots = tokens(text)
    words = [text[a:b] for a, b in spots]
    chain = [
        (k - 1, k) for k in range(1, len(spots)) if text[spots[k - 1][1] : spots[k][0]].strip("\"'`<>[]{};:,.!?*#$%&|= ") == ""
        and "\n" not in text[spots[k - 1][1] : spots[k][0]]
    ]
    tied = set(chain)
    last: dict[str, int] = {}
    skip = []
    alike = list(range(len(spots)))

    def first(k: int) -> int:
        while alike[k] != k:
            alike[k] = alike[alike[k]]
            k = alike[k]
        return k

    for k, word in enumerate(words):
        plain = "".join(c for c in word.lower() if c.isalnum())
        digits = _NO_DIGIT.sub("", word)
        forms = {f"w{plain}"} | ({f"d{digits}"} if len(digits) >= 4 else set())
        before = {last[f] for f in forms if f in last}
        skip += [(b, k) for b in sorted(before) if (b, k) not in tied]
        for b in before:
            one, two = sorted((first(b), first(k)))
            alike[two] = one
        last.update(dict.fromkeys(forms, k))
    keyed = [is_secret(w) and is_keyed(text, a) for w, (a, _) in zip(words, spots, strict=True)]
    roots = [first(k) for k in range(len(spots))]
    # mentions share what stands before any of them
    announced = {r for r, k in zip(roots, keyed, strict=True) if k}
    shapes = [shape(w, r in announced and is_secret(w)) for w, r in zip(words, roots, strict=True)]
    return Graph(spots, shapes, chain, skip, roots, keyed)


def marks(g: Graph, base: list[Span]) -> list[int]:
    """What the field learns from: labels by base span, else a secret behind a key word."""
    return [m or (1 + SECRET if k else 0) for m, k in zip(labels(g.spots, base), g.keyed, strict=True)]


def labels(spots: list[tuple[int, int]], base: list[Span]) -> list[int]:
    """0 or 1 + kind of the base span that touches each token, the first of several."""
    found, at = [], 0
    ordered = sorted(base)
    for start, end in spots:
        while at < len(ordered) and ordered[at][1] <= start:
            at += 1
        found.append(1 + ordered[at][2] if at < len(ordered) and ordered[at][0] < end else 0)
    return found


@dataclass
class Field:
    """Log potentials: of a shape's features by label, and of the labels at both ends of an edge."""

    node: np.ndarray  # features + 1, labels
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, known: list[int] | None = None) -> np.ndarray:
        """Label probabilities of each token, by loopy sum-product messages; labels in ``known`` but 0 are observed."""
        n, width = len(g.spots), self.node.shape[1]
        if not n:
            return np.zeros((0, width))
        bits = (np.array(g.shapes, dtype=np.int64)[:, None] >> np.arange(N_FEATURES)) & 1
        own = np.concatenate([bits, np.ones((n, 1))], axis=1) @ self.node
        for k, label in enumerate(known or ()):
            if label:
                own[k] = -OBSERVED
                own[k, label] = 0.0
        edges = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
        kinds = np.stack([self.chain] * len(g.chain) + [self.skip] * len(g.skip)) if len(edges) else np.zeros((0, width, width))
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([kinds, kinds.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(source), width))
        for _ in range(ROUNDS if len(edges) else 0):
            total = own.copy()
            np.add.at(total, target, message)
            out = (total[source] - message[back])[:, :, None] + potential
            top = out.max(axis=1, keepdims=True)
            new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new - message).max()
            message = new
            if moved < 1e-4:
                break
        total = own.copy()
        np.add.at(total, target, message)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


def bears_out(kind: int, text: str, keyed: bool) -> bool:
    """Whether the text of a run may be of a kind for itself."""
    digits = _NO_DIGIT.sub("", text)
    if kind == SECRET:
        return keyed
    if kind == KINDS.index("card"):
        return 14 <= len(digits) <= 19 and _CARD.fullmatch(text) is not None and luhn(digits)
    if kind == KINDS.index("phone"):
        return 10 <= len(digits) <= 15 and text[0] in "+(" and not any(c.isalpha() for c in text)
    return any(s == (0, len(text), kind) for s in base_spans(text))


def _mentions(kind: int, text: str) -> bool:
    """Whether a text is long enough to be another mention of a kind."""
    return len(_NO_DIGIT.sub("", text)) >= MENTION.get(kind, 0)


def more_spans(text: str, base: list[Span], field: Field, sure: float = SURE) -> list[Span]:
    """Spans the field adds: runs of tokens of one label that no base span touches and whose text bears it out."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    g = graph(text)
    known = labels(g.spots, base)
    chances = field.marginals(g, marks(g, base))
    best = chances.argmax(axis=1)
    joined = set(g.chain)
    runs: list[list[int]] = []
    for k in range(len(g.spots)):
        if known[k] or not best[k] or chances[k, best[k]] < sure:
            continue
        kind = best[k]
        if runs and runs[-1][-1] == k - 1 and best[k - 1] == kind and kind != 1 + SECRET and (k - 1, k) in joined:
            runs[-1].append(k)
        else:
            runs.append([k])
    proven = {(g.alike[k], label - 1) for k, label in enumerate(known) if label}
    held: list[tuple[list[int], Span, bool]] = []
    for run in runs:
        start, end, kind = g.spots[run[0]][0], g.spots[run[-1]][1], int(best[run[0]]) - 1
        right = bears_out(kind, text[start:end], g.keyed[run[0]])
        held.append((run, (start, end, kind), right))
        if right:
            proven.update((g.alike[k], kind) for k in run)
    found = []
    for run, span, right in held:
        if right:
            found.append(span)
            continue
        found += [
            (*g.spots[k], span[2]) for k in run if (g.alike[k], span[2]) in proven and _mentions(span[2], text[slice(*g.spots[k])])
        ]
    return found


def fit(docs: DataFrame) -> Field:
    """Potentials from the base spans and announced secrets of all rows of ``docs``.

    What comes back is one row per combination of features and label, and per pair of labels.
    """
    rows = docs.select(text_of(docs).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, int, int]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if "@" not in text and not _DIGIT.search(text):
                    continue
                g = graph(text)
                known = marks(g, base_spans(text))
                seen.update(("node", a, b) for a, b in zip(g.shapes, known, strict=True))
                seen.update(("chain", known[a], known[b]) for a, b in g.chain)
                seen.update(("skip", known[a], known[b]) for a, b in g.skip)
        columns = list(zip(*seen, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.string()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.int64()),
                pa.array(list(seen.values()), pa.int64()),
            ],
            names=["what", "a", "b", "n"],
        )

    counts: dict[str, dict[tuple[int, int], int]] = defaultdict(dict)
    summed = rows.mapInArrow(count, "what string, a long, b long, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    for row in summed.orderBy("what", "a", "b").collect():
        counts[row["what"]][row["a"], row["b"]] = row["n"]
    return Field(_fit_node(counts["node"]), _fit_edge(counts["chain"]), _fit_edge(counts["skip"], same=True))


def _fit_edge(counts: dict[tuple[int, int], int], same: bool = False) -> np.ndarray:
    """Log of how much more often two labels meet than by chance; ``same``: symmetric, never against equal labels."""
    width = len(LABELS) + 1
    table = np.full((width, width), 0.5)
    for (a, b), n in counts.items():
        table[a, b] += n
    if same:
        table = table + table.T + 2 * np.eye(width)
    share = table / table.sum()
    found = np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))
    if same:
        found = np.where(np.eye(width) > 0, np.maximum(found, 0.5), np.minimum(found, 0.0))
    else:
        # what personal data of another kind stands beside is chance
        kind = np.arange(width)
        found[(kind[:, None] != kind) & (kind[:, None] > 0) & (kind > 0)] = 0.0
    return np.clip(found, -4.0, 4.0)


def _fit_node(counts: dict[tuple[int, int], int], steps: int = 400, decay: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression on the counted combinations."""
    width = len(LABELS) + 1
    shapes = sorted({a for a, _ in counts})
    weights = np.zeros((N_FEATURES + 1, width))
    if not shapes:
        weights[-1, 0] = 10.0  # nothing was seen: nothing is added
        return weights
    x = np.ones((len(shapes), N_FEATURES + 1))
    x[:, :-1] = (np.array(shapes, dtype=np.int64)[:, None] >> np.arange(N_FEATURES)) & 1
    y = np.zeros((len(shapes), width))
    for (a, b), n in counts.items():
        y[shapes.index(a), b] += n
    # frequent combinations should not drown rare ones
    y *= (np.sqrt(y.sum(axis=1)) / y.sum(axis=1))[:, None]
    total = y.sum()
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):  # Adam
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p * y.sum(axis=1, keepdims=True) - y) / total + decay * weights
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        weights -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def _text(spans: list[Span]) -> str:
    return ",".join(f"{LABELS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans.

    Places are code points of the whole text, ends exclusive. Columns of these names are
    replaced, others stay. A null text counts as empty and has no spans; an empty table gives an empty one. ``spans``
    also holds ``secret`` spans.
    """
    added = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"]
    base_docs = without(docs, *added)
    sent = docs.sparkSession.sparkContext.broadcast(field or fit(docs))
    text_at = [c.lower() for c in base_docs.columns].index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base_docs.schema)
    schema += "".join(f", n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    names = [*base_docs.columns, *added]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, more = [], [], [], []
            for text in batch.column(text_at).to_pylist():
                base = base_spans(text)
                further = more_spans(text or "", base, sent.value)
                tally = Counter(k for _, _, k in base)
                counts.append([tally[k] for k in range(len(KINDS))])
                digests.append(hashlib.sha256(_text(base).encode()).hexdigest())
                spans.append(_text(base + further))
                more.append(len(further))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            columns += [pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)

    return base_docs.mapInArrow(mark, schema)
