"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers. The random field
labels the text's runs of letters, digits and ``@._%+()-`` that have a digit or ``@``; everything
else is "other" for sure, which cuts the chain between the runs exactly and keeps the work in
proportion to the runs that matter. What a run, what stands before it and what its neighbours look
like give its own potentials; neighbours with only white space between them share chain
potentials; and all runs of a document that recur or resemble each other (the same characters, or
the same last seven digits), however far apart, share skip potentials through a node of their own:
the label of what they all mention. Loopy message passing makes their labels agree, so that a number
which is recognisable in one place is found wherever it comes again, as ``5553824`` after
``+1 (743) 555-3824``, and is left alone in documents where nothing says what it is.

The field is fitted to documents that a fixed rule makes up and whose labels are known from the
making: own, chain and skip potentials together, for the likelihood of all labels of a document. So nothing
of the corpus goes to the driver, and a document's result depends on its text alone. What the field
labels with a probability of at least CERTAIN and no pattern's span touches is added; spans of
patterns stay as they are. Besides the patterns' kinds it knows one more: a secret, such as the
value of an access token.

Messages are passed until none changes by more than SETTLED, or for MOST_ROUNDS rounds in graphs
that swing. Documents go through in groups of about GROUP_RUNS runs, at least one document each:
memory is bounded by that and by the longest single document.

Defined results: null and empty texts have no spans; an empty table has no rows. Offsets count code
points, ends are exclusive. Very long texts and very long runs are read whole, in linear time.
Repeated rows, and rows that share an id or have none, are treated each on their own. Of spans that
start together the longer one masks. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone")
#: The field's kinds; secrets have no pattern.
FOUND = (*KINDS, "secret")
LABELS = ("other", *FOUND)
CERTAIN, SETTLED, MOST_ROUNDS = 0.8, 1e-3, 200
#: Runs that go through message passing together.
GROUP_RUNS = 20_000
#: Made-up documents to fit the field to.
MADE_UP = 400

Span = tuple[str, int, int]

_ANY = re.compile(r"[0-9@]")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN, _IN_RUN = re.compile(r"[A-Za-z0-9@._%+()-]+"), _LOCAL | frozenset("@()")
_NOT_DIGIT, _HEX = re.compile(r"[^0-9]+"), re.compile(r"[0-9a-fA-F]+")
_SPACE = " \t\n\r\x0b\x0c"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Around each @: linear, where the pattern by itself tries every start of a long run."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, by kind and then start."""
    if not _ANY.search(text):
        return []
    out = list(_emails(text))
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") for x in m.group().split(".")]
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Starts and ends of the runs that may be personal data."""
    free, m = 0, _ANY.search(text)
    while m:
        start = m.start()
        while start > free and text[start - 1] in _IN_RUN:
            start -= 1
        free = _RUN.match(text, m.start()).end()
        yield start, free
        m = _ANY.search(text, free)


# Own features, by number.
_BIAS, _DIGITS, _DOTS, _ADDRESS, _AT, _PLUS, _BRACKET, _DASH, _LETTERS, _LENGTH, _IP4, _VALID, _INVALID, _SET, _QUOTED = 0, 1, 24, 29, 30, 31, 32, 33, 34, 37, 47, 48, 49, 50, 51
OWN = 52
#: Own features, and those of the run before and after if only white space lies between; all again for runs that others are alike.
FEATURES = 6 * OWN
#: Three shapes of keys by how many runs have them: 2 or 3, 4 to 7, more.
NODE_FEATURES = 9


def looks(text: str, start: int, end: int) -> list[int]:
    """Features of a run by itself and of what stands before it, as numbers below OWN."""
    run = text[start:end]
    core = run.strip("._%+()-")
    digits = _NOT_DIGIT.sub("", core)
    n, dots, at = len(digits), core.count("."), core.find("@")
    letters = 0 if n + dots + core.count("-") + core.count("(") + core.count(")") == len(core) else 1 if _HEX.fullmatch(core) else 2
    out = [_BIAS, _DIGITS + min(n, 22), _DOTS + min(dots, 4), _LETTERS + letters, _LENGTH + min(len(core).bit_length(), 9)]
    if at >= 0:
        out.append(_ADDRESS if at and "." in core[at:] else _AT)
    if run[0] == "+":
        out.append(_PLUS)
    if "(" in run or ")" in run:
        out.append(_BRACKET)
    if "-" in core:
        out.append(_DASH)
    if dots == 3 and n + 3 == len(core) and n <= 12 and all(x and int(x) < 256 for x in core.split(".")):
        out.append(_IP4)
    if 13 <= n <= 19 and n == len(core):
        out.append(_VALID if luhn(digits) else _INVALID)
    before = start - 1
    if before >= 0 and text[before] in "\"'`":
        out.append(_QUOTED)
        before -= 1
    while before >= 0 and text[before] == " ":
        before -= 1
    if before >= 0 and text[before] in "=:":
        out.append(_SET)
    return out


def alike(run: str) -> str | None:
    """Runs with the same key mention the same thing."""
    core = run.strip("._%+()-").lower()
    if "@" in core or core.count(".") == 3:
        return core
    digits = _NOT_DIGIT.sub("", core)
    if len(digits) < 7:
        return None
    return digits[-7:] if len(digits) + core.count("-") + core.count("(") + core.count(")") + core.count(".") == len(core) else core


class Graph:
    """Runs of several documents with their features and edges, and the nodes that runs alike share."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.cols: list[int] = []
        self.ends: list[int] = []  # where each run's features end
        self.share: list[float] = []  # of runs alike that look the same each counts for its share, so that saying it again proves nothing
        self.chain: list[int] = []  # runs that follow the one before with only white space between
        self.skip: list[tuple[int, int]] = []  # run, node
        self.nodes: list[int] = []  # each one's feature

    def add(self, doc: int, text: str) -> None:
        first, own, again = len(self.spans), [], {}
        seen: dict[str, list[int]] = {}
        for start, end in runs(text):
            n = len(self.spans)
            self.spans.append((doc, start, end))
            own.append(looks(text, start, end))
            if n > first and not text[self.spans[n - 1][2] : start].strip(_SPACE):
                self.chain.append(n)
            key = alike(text[start:end])
            if key is not None:
                seen.setdefault(key, []).append(n)
        for key, all_ in seen.items():
            if len(all_) > 1:
                self.skip += [(n, len(self.nodes)) for n in all_]
                self.nodes.append(3 * (0 if key.isdigit() else 1 if "@" in key or "." in key else 2) + min(len(all_).bit_length(), 4) - 2)
                looked = Counter(tuple(own[n - first]) for n in all_)
                again |= {n: 1 / looked[tuple(own[n - first])] for n in all_}
        after = set(self.chain[-len(own) :]) if own else ()
        for i, x in enumerate(own):
            block = 3 * OWN if first + i in again else 0
            self.cols += [block + f for f in x]
            if first + i in after:
                self.cols += [block + OWN + f for f in own[i - 1]]
            if first + i + 1 in after:
                self.cols += [block + 2 * OWN + f for f in own[i + 1]]
            self.ends.append(len(self.cols))
            self.share.append(again.get(first + i, 1.0))

    def own(self, weights: np.ndarray) -> np.ndarray:
        """Sums of the weights of each run's features, few runs at a time."""
        cols, ends, out = np.array(self.cols, np.int32), np.array(self.ends, np.int64), np.zeros((len(self.ends), weights.shape[1]))
        for i in range(0, len(ends), 4096):
            begin = int(ends[i - 1]) if i else 0
            starts = np.concatenate([[begin], ends[i : i + 4096][:-1]]) - begin
            out[i : i + 4096] = np.add.reduceat(weights[cols[begin : ends[min(i + 4096, len(ends)) - 1]]], starts)
        return out * np.array(self.share)[:, None]

    def labels(self, spans: dict[int, list[Span]]) -> np.ndarray:
        return np.array([next((LABELS.index(k) for k, s, e in spans.get(d, ()) if s < end and start < e), 0) for d, start, end in self.spans], int)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _passed(x: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Log messages from log beliefs [edge, label] through potentials [label, label at the other end]."""
    return np.log(np.exp(x - x.max(1, keepdims=True)) @ np.exp(pair))


class Field:
    """Own potentials by feature, chain potentials [label, next label], skip potentials [label of the mentioned, label of the run], and the mentioned's own by feature."""

    def __init__(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray, node: np.ndarray):
        self.own, self.chain, self.skip, self.node = own, chain, skip, node

    @classmethod
    def fit(cls, made: list[tuple[str, list[Span]]], steps: int = 250, joint: int = 150, decay: float = 5e-5) -> Field:
        """By the pseudo-likelihood at first, each run's label given its features and the true labels next to it.

        Then by the likelihood of all labels of a document together, whose gradient is what the
        truth has less what message passing expects. A node's true label is what most of its runs have.
        """
        graph, kinds = Graph(), len(LABELS)
        for i, (text, _) in enumerate(made):
            graph.add(i, text)
        y = graph.labels({i: s for i, (_, s) in enumerate(made)})
        n, one = len(y), np.eye(kinds)
        x = np.zeros((n, FEATURES))
        x[np.repeat(np.arange(n), np.diff(graph.ends, prepend=0)), graph.cols] = np.repeat(graph.share, np.diff(graph.ends, prepend=0))
        edges = Edges(graph)
        right, run, node = edges.right, edges.run, edges.node
        votes = np.zeros((len(graph.nodes), kinds))
        np.add.at(votes, (node, y[run]), 1)
        y = np.concatenate([y, votes.argmax(1)])
        p = [np.zeros((FEATURES, kinds)), np.zeros((kinds, kinds)), np.zeros((kinds, kinds)), np.zeros((NODE_FEATURES, kinds))]
        of_node = np.eye(NODE_FEATURES)[graph.nodes]
        moved = [np.zeros_like(q) for q in p]

        def step(gradients, rate: float) -> None:
            for i, g in enumerate(gradients):
                moved[i] = 0.9 * moved[i] + g / n - decay * p[i]
                p[i] = p[i] + rate * moved[i]
            p[2] = p[2] - np.log(np.exp(p[2]).sum(1, keepdims=True))  # a run that tells nothing has no say in its node's label

        after, before, mentioned = np.zeros((n, kinds)), np.zeros((n, kinds)), np.zeros((n, kinds))
        after[right], before[right - 1], mentioned[run] = one[y[right - 1]], one[y[right]], one[y[n + node]]
        for _ in range(steps):
            miss = one[y[:n]] - _softmax(x @ p[0] + after @ p[1] + before @ p[1].T + mentioned @ p[2])
            step((x.T @ miss, after.T @ miss + (before.T @ miss).T, mentioned.T @ miss), 1.5)
        truth = one[y[right - 1]].T @ one[y[right]], one[y[n + node]].T @ one[y[run]]
        moved, sent = [np.zeros_like(q) for q in p], None
        for _ in range(joint):  # messages go on from one step to the next
            belief, sent = edges.passed(np.concatenate([x @ p[0], of_node @ p[3]]), p[1], p[2], 5, sent)
            pairs = edges.expected(belief, sent, p[1], p[2])
            miss = one[y] - _softmax(belief)
            step((x.T @ miss[:n], *(t - q for t, q in zip(truth, pairs, strict=True)), of_node.T @ miss[n:]), 1.0)
        return cls(*p)

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label probabilities of each run."""
        own = np.concatenate([graph.own(self.own), self.node[np.array(graph.nodes, np.int64)]])
        return _softmax(Edges(graph).passed(own, self.chain, self.skip, MOST_ROUNDS)[0][: len(graph.spans)])


class Edges:
    """A graph's edges both ways: runs before to runs after, nodes to their runs, and back in the same order."""

    def __init__(self, graph: Graph):
        self.right, pairs = np.array(graph.chain, np.int64), np.array(graph.skip, np.int64).reshape(-1, 2)
        self.run, self.node = pairs[:, 0], pairs[:, 1]
        n = len(graph.spans)
        a, b = np.concatenate([self.right - 1, n + self.node]), np.concatenate([self.right, self.run])
        self.of, self.to = np.concatenate([a, b]), np.concatenate([b, a])
        self.e, self.c = len(a), len(self.right)
        self.back = np.concatenate([np.arange(self.e, 2 * self.e), np.arange(self.e)])

    def passed(self, own: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int, sent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of runs and nodes, and messages, after damped rounds of sum-product."""
        kinds, e, c = own.shape[1], self.e, self.c
        sent = np.zeros((2 * e, kinds)) if sent is None else sent
        gathered = lambda: own + np.stack([np.bincount(self.to, sent[:, k], len(own)) for k in range(kinds)], 1)
        belief = gathered() if e else own
        for _ in range(rounds if e else 0):
            into, new = belief[self.of] - sent[self.back], np.empty_like(sent)
            for at, end, pair in ((0, c, chain), (c, e, skip), (e, e + c, chain.T), (e + c, 2 * e, skip.T)):
                new[at:end] = _passed(into[at:end], pair)
            new -= new.max(1, keepdims=True)
            change = float(np.abs(new - sent).max())
            sent = 0.5 * (sent + new)
            belief = gathered()
            if change < SETTLED:
                break
        return belief, sent

    def expected(self, belief: np.ndarray, sent: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> Iterator[np.ndarray]:
        """How often each pair of labels is expected on chain and on skip edges."""
        into = belief[self.of] - sent[self.back]
        for at, end, pair in ((0, self.c, chain), (self.c, self.e, skip)):
            both = into[at:end, :, None] + pair + into[self.e + at : self.e + end, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            yield (both / both.sum((1, 2), keepdims=True)).sum(0)


def made_up(n: int = MADE_UP, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Documents by a fixed rule, with the spans of what they mention.

    Things of each kind, told by their form or by what stands before them; later mentions of some that
    by themselves could be anything; and numbers, codes and names that are nothing of the sort, of
    which some recur as well.
    """
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def code(n):
        x = hashlib.sha256(number(9).encode()).hexdigest()[:n]
        return x.upper() if r.random() < 0.2 else x

    def card():
        digits = number(15)
        return next(digits + str(k) for k in range(10) if luhn(digits + str(k)))

    def thing() -> list[tuple[str, str]]:
        """What stands before, and the mention: the first and later ones."""
        kind = r.choice(FOUND)
        if kind == "email":
            x = f"{word()}{r.choice(('.', '_', ''))}{r.choice((word(), number(2)))}@{word()}{r.choice(('', number(1)))}.{r.choice(('com', 'org', 'example.com'))}"
            all_ = [x, x]
        elif kind == "ip":
            x = ".".join(str(r.randint(0, 255)) for _ in range(4))
            all_ = [x, x]
        elif kind == "card":
            x = card() if r.random() < 0.5 else number(16)
            all_ = [x if r.random() < 0.7 else r.choice(" -").join(x[i : i + 4] for i in range(0, 16, 4)), x]
        elif kind == "phone":
            area, a, b = number(3), number(3), number(4)
            plain = r.choice((a + b, area + a + b, f"{a}-{b}"))
            all_ = [f"+{r.randint(1, 99)} {r.choice((f'({area})', area))} {a}{r.choice('- .')}{b}", r.choice((f"{a}-{b}", a + b, area + a + b, f"{area}-{a}-{b}", f"({area}) {a}-{b}")), plain]
        else:
            x = code(r.choice((32, 40, 64)))
            quote = r.choice(('"', '"', "'", ""))
            cue = (kind, f"{r.choice((word(), 'token', 'key', 'secret'))} {r.choice(('=', '=', ':'))} {quote}", x, quote)
            return [cue, *r.choices((cue, (kind, r.choice(("", '"')), x, "")), k=r.choice((0, 0, 1, 1, 2, 5)))]
        return [(kind, "", x, "") for x in [*all_, *all_[-1:] * 9][: r.choice((1, 1, 1, 2, 2, 3, 6, 11))]]

    def nothing() -> list[tuple[str, str]]:
        x = r.choice((
            lambda: number(r.randint(1, 6)), lambda: number(r.randint(7, 12)), lambda: number(7), lambda: number(10), lambda: f"{number(3)}-{number(4)}",
            lambda: f"{r.randint(1900, 2030)}", lambda: f"{number(1)}.{number(1)}", lambda: f"{number(2)}.{number(2)}", lambda: f"{number(1)}.{number(1)}.{number(2)}", lambda: f"v{number(1)}.{number(2)}",
            lambda: f"{r.randint(1, 28)}-{r.randint(1, 12)}-{r.randint(1990, 2030)}", lambda: f"{number(3)}-{number(1)}-{number(5)}-{number(2)}", lambda: f"@{word()}", lambda: f"{word()}{number(2)}", lambda: code(r.choice((8, 12, 40, 40))),
            lambda: f"({number(2)})", lambda: f"{number(2)}%", lambda: f"{number(3)}.{number(3)}.{number(3)}.{number(3)}.{number(2)}", lambda: f"{word()}-{number(4)}", lambda: number(r.choice((13, 14, 17, 18))) + r.choice("abcx"),
        ))()
        before = r.choice(("", "", "", f"{word()} = ", f"{word()}: ")) if len(x) < 20 else ""
        return [("", before, x, "")] * r.choice((1, 2, 3, 5) if alike(x) else (1, 1, 1, 2))

    for _ in range(n):
        items = [m for _ in range(r.randint(0, 4)) for m in thing()] + [m for _ in range(r.randint(1, 6)) for m in nothing()]
        first = {id(x): i for i, x in enumerate(items)}
        items = sorted(items, key=lambda x: first[id(x)] + 6 * r.random())
        text, spans = word(), []
        for kind, before, x, behind in items:
            text += r.choice((" ", f" {word()} ", f" {word()} {word()} ", f", {word()} ")) + before
            if kind:
                spans.append((kind, len(text), len(text) + len(x)))
            text += x + behind + r.choice(("", "", ".", ",", "!!"))
        out.append((f"{text} {word()}", spans))
    return out


@functools.cache
def standard() -> Field:
    return Field.fit(made_up())


def added_spans(graph: Graph, marginals: np.ndarray, texts: list[str], base: list[list[Span]], certain: float = CERTAIN) -> dict[int, list[Span]]:
    """Neighbouring runs that surely have one label, where no pattern's span is."""
    label = np.where(marginals.max(1) >= certain, marginals.argmax(1), 0)
    linked, out, covered = set(graph.chain), {}, {}
    for i in np.flatnonzero(label).tolist():
        if i in linked and label[i] == label[i - 1]:
            continue  # the one before has taken it
        j = i + 1
        while j in linked and j < len(label) and label[j] == label[i]:
            j += 1
        doc, start, _ = graph.spans[i]
        end, text = graph.spans[j - 1][2], texts[doc]
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while start < end and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if doc not in covered:
            by = sorted((s, e) for _, s, e in base[doc])
            covered[doc] = np.array([s for s, _ in by], int), np.maximum.accumulate([e for _, e in by]) if by else np.zeros(0, int)
        starts, ends = covered[doc]
        k = int(np.searchsorted(starts, end))  # spans that start before the end
        if start < end and not (k and ends[k - 1] > start):
            out.setdefault(doc, []).append((FOUND[label[i] - 1], start, end))
    return out


def find(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """The patterns' spans and all spans of each text, by kind and then start."""
    base, more, graph = [base_spans(x) for x in texts], {}, Graph()
    for i, x in enumerate(texts):
        if _ANY.search(x):
            graph.add(i, x)
        if graph.spans and (i + 1 == len(texts) or len(graph.spans) >= GROUP_RUNS):
            more |= added_spans(graph, field.marginals(graph), texts, base)
            graph = Graph()
    return [(b, sorted(b + more.get(i, []), key=lambda s: (FOUND.index(s[0]), s[1]))) for i, b in enumerate(base)]


def _text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (all of the patterns' spans), spans, n_added, n_spans."""
    field = field or standard()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = find(field, [x or "" for x in part.column(1).to_pylist()])
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                sha = pa.array([hashlib.sha256(_text(b).encode()).hexdigest() for b, _ in found], pa.string())
                more = [pa.array(x, pa.int64()) for x in ([len(a) - len(b) for b, a in found], [len(a) for _, a in found])]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sha, pa.array([_text(a) for _, a in found], pa.string()), *more], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """docs with personal data in ``text`` replaced; all other columns and null texts as they are."""
    field = field or standard()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column(at).to_pylist()
                found = find(field, [x or "" for x in texts])
                new = pa.array([None if x is None else masked(x, a) for x, (_, a) in zip(texts, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([new if k == at else part.column(k) for k in range(part.num_columns)], part.schema.names)

    return map_arrow(docs, run, docs.schema)
