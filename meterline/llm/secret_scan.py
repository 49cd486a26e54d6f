"""Secret scans (operator 8): fixed patterns, and formats learned by grammar inference.

Labelled credentials of each kind form a prefix tree: over characters in the part with which nearly all of them begin,
over groups of character classes after it. States whose outgoing frequencies agree, by the log-likelihood that one
distribution for both would lose, are merged (red-blue order, merges folded down so that the automaton stays
deterministic), which leaves a small probabilistic automaton for
each kind. Every token of a text that the fixed pattern could label, inside its matches too, and where it is none each
part between dots, is scored by its log-likelihood a character under the formats against a background of all such
tokens (long ones without dots, and the others, which are mostly words, have one each).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .tables import col, map_texts, texts_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the leftmost match of 24 or more is a whole run
#: Candidates: the characters and the least length of a labelled value of ASSIGN; PART is one between dots.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
LONG = 16
PART = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Character classes: digits, a-f, g-z, A-F, G-Z, and each of the other characters of a token.
_GROUPS = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-"]
_CLASS = {c: n for n, group in enumerate(_GROUPS) for c in group}
#: A class says this much of a character: a character of its own says all.
_INSIDE = [-math.log(len(group)) for group in _GROUPS]
#: A beginning is learned as characters while this share of a kind's credentials has it.
SHARED = 0.95
CLASSES, END = 11, 11
_LETTERS = str.maketrans({c: chr(97 + n) for c, n in _CLASS.items()})  # a class as a letter
_DOT = ".".translate(_LETTERS)
#: Class sequences, and their scores, that are kept at once.
KEPT = 200_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three fixed patterns, by start, then kind."""
    lower, out = text.lower(), []
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):  # every match of ASSIGN has one of them
        out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _value(text: str, span: tuple[str, int, int]) -> str:
    if span[0] == "assign":
        return ASSIGN.match(text, span[1]).group(2)
    return text[span[1] : span[2]]


def classes(value: str) -> list[int]:
    return [_CLASS[c] for c in value if c in _CLASS]


def beginning(values: list[str]) -> str:
    """The longest text with which at least SHARED of the values begin, of at least 20 values."""
    out = ""
    while len(values) >= 20:
        following = Counter(v[len(out)] for v in values if len(v) > len(out) and v.startswith(out))
        c, n = max(following.items(), key=lambda x: (x[1], x[0]), default=("", 0))
        if n < SHARED * len(values):
            break
        out += c
    return out


def symbols(value: str, begins: str) -> list[int]:
    """Characters (as numbers from 256) of the beginning if the value has it, then classes."""
    n = len(begins) if value.startswith(begins) else 0
    return [256 + ord(c) for c in value[:n]] + classes(value[n:])


@dataclass
class Automaton:
    """State 0 is the start; ``moves[state][class] = (next state, log probability)``, ``ends[state]`` a log probability."""

    moves: list[dict[int, tuple[int, float]]] = field(default_factory=list)
    ends: list[float] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    spread: float = 0.0  # variance of the lengths

    def score(self, word: list[int], floor: float) -> float:
        """Log-likelihood of the word's characters, even inside a class; a missing move costs ``floor`` and stays in its
        state, and so does an end where none was seen."""
        state, total = 0, 0.0
        for c in word:
            step = self.moves[state].get(c)
            total += _INSIDE[c] if c < 256 else 0.0
            if step is None:
                total += floor
            else:
                state = step[0]
                total += step[1]
        return total + max(self.ends[state], floor)

    def likely_length(self, word: list[int], floor: float) -> bool:
        """Whether the number of moves that the word makes is one of the learned lengths, or at a distance from the nearest
        that is no less likely than ``floor`` under a normal curve as wide as they are spread, and one more."""
        state, made = 0, 0
        for c in word:
            step = self.moves[state].get(c)
            if step is not None:
                state, made = step[0], made + 1
        d = min((abs(made - n) for n in self.lengths), default=0)
        return -d * d / (2 * (self.spread + 1)) >= floor


def _entropy(counts) -> tuple[float, int]:
    """Of counts: the log-likelihood that their shares give them, and the number of free shares."""
    n = sum(counts)
    return sum(c * math.log(c / n) for c in counts if c), max(0, sum(1 for c in counts if c) - 1)


def _cost(first: dict, second: dict) -> tuple[float, int]:
    """What one distribution for both sets of counts loses in log-likelihood, and how many free shares it saves."""
    (l1, k1), (l2, k2) = _entropy(first.values()), _entropy(second.values())
    l, k = _entropy([first.get(c, 0) + second.get(c, 0) for c in first.keys() | second.keys()])
    return l1 + l2 - l, k1 + k2 - k


def alphabet(words: list[list[int]]) -> dict[int, int]:
    """Classes that stand for one another: each class's group, named by its least class.

    Two groups become one while the groups before and after them are distributed alike, by the same criterion as states.
    So the digits and letters of random hex are one symbol, and words of one length share one path of states.
    """
    of = {c: c for w in words for c in w}
    share = 0.5 * math.log(max(2, sum(map(len, words))))
    while True:
        after: dict[int, Counter] = {g: Counter() for g in of.values()}
        before: dict[int, Counter] = {g: Counter() for g in of.values()}
        for w in words:
            groups = [of[c] for c in w]
            for x, y in zip([END, *groups], [*groups, END]):
                if x != END:
                    after[x][y] += 1
                if y != END:
                    before[y][x] += 1
        best = None
        for x in sorted(after):
            for y in sorted(after):
                if x < y < 256:
                    pairs = [_cost(after[x], after[y]), _cost(before[x], before[y])]
                    spare = share * sum(k for _, k in pairs) - sum(lost for lost, _ in pairs)
                    if spare >= 0 and (best is None or spare > best[0]):
                        best = spare, x, y
        if best is None:
            return of
        of = {c: best[1] if g == best[2] else g for c, g in of.items()}


def infer(words: list[list[int]], penalty: float = 0.5) -> Automaton:
    """Merges statistically compatible states of the prefix tree of ``words`` into a probabilistic automaton.

    Red-blue order. Two states are compatible if one distribution for both, and for all states that fold together
    below them, loses no more log-likelihood than ``penalty * log(words)`` for each free share that it saves (the Bayes
    information criterion at 0.5). Where all words end together, states of different depths never fold: they count.
    """
    child: list[dict[int, int]] = [{}]
    counts: list[Counter] = [Counter()]  # of moves by symbol, and of ends as None
    for w in words:
        s = 0
        for c in w:
            if c not in child[s]:
                child[s][c] = len(child)
                child.append({}), counts.append(Counter())
            counts[s][c] += 1
            s = child[s][c]
        counts[s][None] += 1
    share = penalty * math.log(max(2, len(words)))

    def compatible(a: int, b: int) -> bool:
        todo, lost, saved = [(a, b)], 0.0, 0
        while todo:
            x, y = todo.pop()
            loss, fewer = _cost(counts[x], counts[y])
            lost, saved = lost + loss, saved + fewer
            todo += [(child[x][c], child[y][c]) for c in child[x].keys() & child[y].keys()]
        return lost <= share * saved + 1e-9

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            counts[x].update(counts[y])
            for c, t in child[y].items():
                if c in child[x]:
                    todo.append((child[x][c], t))
                else:
                    child[x][c] = t

    red, known = [0], {0}
    blue = [(0, c) for c in sorted(child[0])]
    while blue:
        parent, c = blue[0]
        b = child[parent][c]
        for r in red:
            if compatible(r, b):
                child[parent][c] = r
                fold(r, b)
                break
        else:
            red.append(b)
            known.add(b)
        blue = [(r, x) for r in red for x in sorted(child[r]) if child[r][x] not in known]
    at = {s: i for i, s in enumerate(red)}
    log = lambda n, d: math.log(n / d) if n else -math.inf
    total = [sum(counts[s].values()) for s in red]
    return Automaton([{c: (at[t], log(counts[s][c], n)) for c, t in child[s].items() if counts[s][c]} for s, n in zip(red, total)], [log(counts[s][None], n) for s, n in zip(red, total)])


def learn(values: list[str], begins: str) -> Automaton:
    """The format of credentials: an automaton over groups of classes, its moves given back by class."""
    words = [symbols(v, begins) for v in values]
    of = alphabet([[c for c in w if c < 256] for w in words])
    seen = Counter(c for w in words for c in w if c < 256)
    grouped = Counter()
    for c, n in seen.items():
        grouped[of[c]] += n
    automaton = infer([[of.get(c, c) for c in w] for w in words])
    for moves in automaton.moves:
        for g, (to, p) in list(moves.items()):
            if g < 256:
                moves.update({c: (to, p + math.log(seen[c] / grouped[g])) for c in of if of[c] == g})
    automaton.lengths, automaton.spread = sorted({len(w) for w in words}), float(np.var([len(w) for w in words]))
    return automaton


def _is_long(token: str) -> bool:
    return len(token) >= LONG and "." not in token


@dataclass
class SecretModel:
    formats: dict[str, Automaton] = field(default_factory=dict)
    begins: dict[str, str] = field(default_factory=dict)
    least: dict[tuple[str, int], float] = field(default_factory=dict)  # by kind and background
    background: np.ndarray | None = None  # of words or parts of sentences, and of long tokens without dots: log probability of a class (or END) after a class (or START = 11)
    floor: float = math.log(1e-4)

    def gain(self, value: str, kind: str, of: int) -> float:
        """Log-likelihood a character under the format less that under a background."""
        word = classes(value)
        other = sum(self.background[of, a, b] for a, b in zip([END, *word], [*word, END])) + sum(_INSIDE[c] for c in word)
        return (self.formats[kind].score(symbols(value, self.begins[kind]), self.floor) - other) / (len(word) + 1)

    def best(self, value: str) -> tuple[float, str, bool]:
        """How far the value is above the least gain of the format that likes it best, that format's kind, and whether it
        accepts the value: at least that gain, and a likely length. Ties: the later kind by name."""
        of = int(_is_long(value))
        margin, kind = max(((self.gain(value, k, of) - self.least[k, of], k) for k in self.formats), default=(-1.0, ""))
        return margin, kind, margin >= 0 and self.formats[kind].likely_length(symbols(value, self.begins[kind]), self.floor)

    def kind_of(self, value: str) -> str | None:
        _, kind, accepted = self.best(value)
        return kind if accepted else None


def fit_secrets(documents: DataFrame, *, text: str = "text", per_kind: int = 400, longest: int = 200, quantile: float = 0.02, share: float = 0.5) -> SecretModel:
    """Formats from the credentials that the fixed patterns label, the background from all candidate tokens of all texts.

    A kind learns from ``per_kind`` distinct credentials at most (those of smallest hash), of up to ``longest``
    characters, over all documents. A
    format accepts what gains at least ``share`` of what all but ``quantile`` of its own credentials gain. Kinds without
    credentials have no format; without any, nothing is added to the fixed patterns.
    """
    ship(documents.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("n", pa.int64())])

    def run(batches):
        pairs = np.zeros((2, CLASSES + 1, CLASSES + 1), np.int64)
        seen: Counter = Counter()

        def add() -> None:
            for shape, n in seen.items():
                word = [END, *(ord(c) - 97 for c in shape), END]
                own = pairs[int(len(shape) >= LONG and _DOT not in shape)]
                for a, b in zip(word, word[1:]):
                    own[a, b] += n
            seen.clear()

        for batch in batches:
            kinds, values = [], []
            for t in texts_of(batch.column(0)):
                body = t.as_py()
                for s in base_spans(body):
                    if len(value := _value(body, s)) <= longest:
                        kinds.append(s[0])
                        values.append(value)
                seen.update(x.translate(_LETTERS) for x in TOKEN.findall(body))
                if len(seen) > KEPT:
                    add()
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array([1] * len(kinds), pa.int64())], schema=schema)
        add()
        at = [tuple(x) for x in np.argwhere(pairs).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(at), pa.string()), pa.array([f"{o} {a} {b}" for o, a, b in at], pa.string()), pa.array([int(pairs[x]) for x in at], pa.int64())], schema=schema)

    found = documents.select(col(text).cast("string").alias("t")).where("t is not null").mapInArrow(run, "kind string, value string, n bigint").groupBy("kind", "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value")
    rows = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.greatest(F.lit(per_kind), F.lit(2 * (CLASSES + 1) ** 2))).collect()
    pairs = np.full((2, CLASSES + 1, CLASSES + 1), 0.5)
    for r in rows:
        if r["kind"] == "pair":
            pairs[tuple(map(int, r["value"].split()))] += r["n"]
    model = SecretModel(background=np.log(pairs / pairs.sum(axis=2, keepdims=True)))
    for kind in KINDS:
        values = sorted(r["value"] for r in rows if r["kind"] == kind and r["r"] <= per_kind and classes(r["value"]))
        if values:
            model.begins[kind] = beginning(values)
            model.formats[kind] = learn(values, model.begins[kind])
            for of in (0, 1):
                model.least[kind, of] = max(0.0, share * float(np.quantile([model.gain(v, kind, of) for v in values], quantile)))
    return model


def scan_secrets(documents: DataFrame, model: SecretModel, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of the kept columns), ``spans`` (``array<struct<kind, start, end, margin>>``) and ``n_candidates`` for every document.

    Kinds assign, access and hex are the fixed patterns; ``like_<kind>`` are tokens outside these spans that a
    learned format accepts. Positions are code points, ends exclusive; order: start, then kind as listed, then
    learned ones. Every candidate token is scored, those in fixed spans too; ``margin`` says how far the best format
    likes a span's value above its least gain (null without formats; it may be positive where the length is not likely), ``n_candidates`` how many were scored.
    Null and empty texts have no spans. Whole texts are scanned; repeated rows give a row each.
    """

    scored: dict[tuple, tuple[float, str, bool]] = {}
    begins = sorted(set(model.begins.values()) - {""})

    def best(value: str) -> tuple[float, str, bool]:
        shape = value.translate(_LETTERS)
        if begins:
            shape = (shape, *[value.startswith(b) for b in begins])
        found = scored.get(shape)
        if found is None:
            if len(scored) >= KEPT:
                scored.clear()
            found = scored[shape] = model.best(value)
        return found

    def fn(texts: pa.Array) -> dict:
        out, numbers = [], []
        for t in texts_of(texts):
            body = t.as_py()
            spans = base_spans(body)
            number = 0
            if model.formats:
                spans = [(*s, best(_value(body, s))[0]) for s in spans]
                tokens = TOKEN.findall(body)
                parts = [p for t in tokens if "." in t for p in PART.findall(t)]
                number = len(tokens) + len(parts)
                if any(best(t)[2] for t in tokens) or any(best(p)[2] for p in parts):  # few texts: where are they?
                    more, number = [], 0
                    for m in TOKEN.finditer(body):
                        margin, kind, accepted = best(m.group())
                        number += 1
                        if accepted and not any(a < m.end() and b > m.start() for _, a, b, _ in spans):
                            more.append((f"like_{kind}", m.start(), m.end(), margin))
                        elif "." in m.group():
                            for p in PART.finditer(body, m.start(), m.end()):
                                margin, kind, accepted = best(p.group())
                                number += 1
                                if accepted and not any(a < p.end() and b > p.start() for _, a, b, _ in spans):
                                    more.append((f"like_{kind}", p.start(), p.end(), margin))
                    spans = sorted(spans + more, key=lambda s: (s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS)))
            else:
                spans = [(*s, None) for s in spans]
            out.append([{"kind": k, "start": a, "end": b, "margin": margin} for k, a, b, margin in spans])
            numbers.append(number)
        return {"spans": out, "n_candidates": numbers}

    return map_texts(documents, text, keep, fn, "spans array<struct<kind:string,start:bigint,end:bigint,margin:double>>, n_candidates bigint")
