"""Toxicity: Levenshtein automata met with a lexicon trie, and context windows around what they find.

The lexicon is learned: words, and word beginnings ("stems"), that labelled toxic documents hold far more often than
others. Its trie is intersected with the Levenshtein automaton of each walk: a state is the set of (trie node, edits)
reached, and all states together make one deterministic automaton over letters, whose transitions are made when a word
first takes them, and kept by the worker for its later tasks. It reads all words of a slice at once, a numpy gather a
letter, so a misspelled term costs no more than any other word. Long terms allow one edit, short none.

Each hit has the weight that its term, at its number of edits, has in the labelled documents. A window around it looks
for marks of quotation and for words that report speech; quoted hits are summed apart from plain ones. A logistic model
over these sums gives the score.

Defined results: a null or empty text has no hits and scores low; without labels of both kinds the score is the share of
label 1 (0.5 without labels); null labels are left out; repeated rows are scored each; other columns play no part.
At most `rows` labelled documents are learned from, chosen by a hash of the id; all documents are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .language import _letters
from .quality import labelled

SAMPLE_ROWS, LEXICON, LEAST_DOCS, LEAST_ODDS, STEM = 20_000, 400, 4, 2.5, (3, 8)
EDIT_FROM, STEM_EDIT_FROM, WINDOW, SLICE_CHARS = 5, 9, 48, 1 << 19
QUOTES = np.array([ord(c) for c in "\"«»“”„‟‹›"], np.uint32)
#: Words that report speech, in the corpus's four languages.
REPORTS = re.compile(r"\b(said|says|wrote|quot\w*|called|word|term|sagte|schrieb|zitat|wort|dit|écrit|mot|cit\w*|dijo|escribió|palabra)\b", re.I)


class Automaton:
    """The union of the terms' Levenshtein automata on their trie, made deterministic as words are read.

    terms: (text, is a stem, edits allowed). After a word, hit[state] is the best (term, edits) or -1.
    """

    made: dict[tuple, Automaton] = {}

    @classmethod
    def of(cls, terms: list[tuple[str, bool, int]]) -> Automaton:
        """The worker's automaton of these terms; one at a time is kept."""
        key = tuple(terms)
        if key not in cls.made:
            cls.made = {key: cls(terms)}
        return cls.made[key]

    def __init__(self, terms: list[tuple[str, bool, int]]):
        self.letters = sorted({c for t, _, _ in terms for c in t})
        self.terms, self.nodes = terms, [{}]
        self.ends: dict[int, list[tuple[int, bool, int]]] = {}
        self.allowed = [0]  # edits allowed by some term below the node
        for k, (text, stem, edits) in enumerate(terms):
            at = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in text:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                    self.allowed.append(0)
                at = self.nodes[at][c]
                self.allowed[at] = max(self.allowed[at], edits)
            self.ends.setdefault(at, []).append((k, stem, edits))
        self.classes = np.zeros(0x110000, np.int32)  # 0: any other letter
        for i, c in enumerate(self.letters, 1):
            self.classes[ord(c)] = i
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.zeros((0, len(self.letters) + 1), np.int32)
        self.hit, self.stem_hit, self.dead = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)
        self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset:
        """With the deletions: a letter of the term that the word lacks."""
        todo, least = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if e > self.allowed[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.nodes[node].values()]
        return frozenset(least.items())

    def _step(self, state: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, e in state:
            if c in self.nodes[node]:
                out.add((self.nodes[node][c], e))
            out.add((node, e + 1))  # an extra letter
            out.update((child, e + 1) for x, child in self.nodes[node].items() if x != c)  # another letter
        return self._closed(out)

    def _best(self, state: frozenset, stems: bool) -> int:
        found = [(e, -len(self.terms[k][0]), k) for node, e in state for k, stem, most in self.ends.get(node, ()) if e <= most and (stem or not stems)]
        return min(found)[2] * 4 + min(found)[0] if found else -1

    def _state(self, state: frozenset) -> int:
        """The number of a state, a new one if it wasn't met before."""
        if state in self.states:
            return self.states[state]
        n = self.states[state] = len(self.states)
        self.sets.append(state)
        if n == len(self.table):  # room for twice as many
            more = max(256, n)
            self.table = np.concatenate([self.table, np.full((more, self.table.shape[1]), -1, np.int32)])
            self.hit, self.stem_hit = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (self.hit, self.stem_hit))
            self.dead = np.concatenate([self.dead, np.zeros(more, bool)])
        self.hit[n], self.stem_hit[n], self.dead[n] = self._best(state, False), self._best(state, True), not state
        return n

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        to = self.table[state, code]
        new = np.flatnonzero(to < 0)
        if len(new):
            for pair in np.unique(state[new].astype(np.int64) * (len(self.letters) + 1) + code[new]).tolist():
                a, c = divmod(pair, len(self.letters) + 1)
                self.table[a, c] = self._state(self._step(self.sets[a], self.letters[c - 1] if c else None))
            to = self.table[state, code]
        return to

    def read(self, letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each word term * 4 + edits, or -1. A stem found on the way counts unless a whole word has as few edits."""
        codes = self.classes[letters]
        found = np.full(len(starts), -1, np.int32)
        going, state, j = np.arange(len(starts)), np.zeros(len(starts), np.int32), 0
        while len(going):
            stem = self.stem_hit[state]
            better = (stem >= 0) & ((found[going] < 0) | (stem % 4 <= found[going] % 4))
            found[going[better]] = stem[better]
            over = starts[going] + j >= ends[going]
            if over.any():
                whole, mine = self.hit[state[over]], going[over]
                better = (whole >= 0) & ((found[mine] < 0) | (whole % 4 <= found[mine] % 4))
                found[mine[better]] = whole[better]
            left = ~over & ~self.dead[state]
            going, state = going[left], state[left]
            state = self._next(state, codes[starts[going] + j])
            j += 1
        return found


def spans(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], letters != 0, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about SLICE_CHARS, with the index of the first."""
    out, size, first = [], 0, 0
    for i, t in enumerate(column):
        out.append(t.as_py() or "")
        size += len(out[-1])
        if size >= SLICE_CHARS:
            yield first, out
            out, size, first = [], 0, i + 1
    if out:
        yield first, out


def slice_hits(automaton: Automaton, part: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: words in each; and of each hit the text, packed term and edits, quoted, share of reports near."""
    joined = "\n".join(part)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[np.minimum(code, 0x10FFFF)]
    starts, ends = spans(letters)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
    of = np.searchsorted(begin, starts, "right") - 1
    found = automaton.read(letters, starts, ends)
    at = np.flatnonzero(found >= 0)
    quoted, reported = np.zeros(len(at), bool), np.zeros(len(at), bool)
    marks = np.flatnonzero(np.isin(code, QUOTES))
    for n, k in enumerate(at):  # hits are few
        a, b = max(begin[of[k]], starts[k] - WINDOW), min(begin[of[k] + 1] - 1, ends[k] + WINDOW)
        lo, mid, hi = np.searchsorted(marks, [a, starts[k], b])
        quoted[n] = (mid - lo) % 2 == 1 and hi > mid or (mid > lo and hi > mid and marks[mid] - marks[mid - 1] <= WINDOW)
        reported[n] = bool(REPORTS.search(joined[a : starts[k]]))
    return np.bincount(of, minlength=len(part)), of[at], found[at], quoted, reported


def features(weight: np.ndarray, number: np.ndarray, of: np.ndarray, found: np.ndarray, quoted: np.ndarray, reported: np.ndarray) -> np.ndarray:
    """A row for each text from its hits; weight[term, edits]."""
    n, w = len(number), weight[found >> 2, found & 3] if len(found) else np.zeros(0)
    plain = ~(quoted | reported)
    most, exact = np.zeros(n), np.zeros(n)
    np.maximum.at(most, of, w)
    np.maximum.at(exact, of[plain], w[plain])
    total = lambda keep: np.bincount(of[keep], np.maximum(w[keep], 0), n)
    rate = total(plain) / np.maximum(number, 1) * 100
    kinds = np.zeros(n)
    if len(found):
        pairs = np.unique(of.astype(np.int64) << 32 | found >> 2)
        kinds = np.bincount((pairs >> 32).astype(int), np.maximum(weight[pairs & 0xFFFFFFFF, 0], 0), n)
    return np.column_stack([most, exact, np.log1p(total(plain)), np.log1p(total(quoted)), np.log1p(total(reported & ~quoted)), np.log1p(rate), np.log1p(kinds), np.log1p(number) / 10])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    """Newton's method for a logistic model; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    hold = np.full(len(beta), ridge)
    hold[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * beta)
        beta += move
        if np.abs(move).max() < 1e-7:
            break
    return beta


class Model:
    def __init__(self, terms: list[tuple[str, bool, int]], weight: np.ndarray, beta: np.ndarray | None, share: float):
        self.terms, self.weight, self.beta, self.share = terms, weight, beta, share

    @property
    def automaton(self) -> Automaton:
        return Automaton.of(self.terms)

    def score(self, part: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.full(len(part), self.share)
        x = features(self.weight, *slice_hits(self.automaton, part))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ self.beta, -30, 30)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, label): each distinct word and word beginning of a document once, summed over the task."""
    seen: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
            for key in {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}:
                seen.setdefault(key, [0, 0])[label] += 1
        if len(seen) > 300_000:
            yield _counted(seen)
            seen.clear()
    if seen:
        yield _counted(seen)


def _counted(seen: dict[tuple[str, bool], list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["term", "stem", "clean", "toxic"])


def odds(toxic, clean, toxics: float, cleans: float):
    return np.log((toxic + 0.5) / (toxics + 1)) - np.log((clean + 0.5) / (cleans + 1))


def choose(rows: list, toxics: int, cleans: int) -> list[tuple[str, bool, int]]:
    """Words and stems by log-odds; a word goes under a stem that is as telling, a stem under a shorter one.

    Stems allow no edit, so long words under one follow the others, as many again at most, to be found misspelled.
    """
    scored = sorted(((len(r.term), r.stem, -float(odds(r.toxic, r.clean, toxics, cleans)), r.term, r.toxic) for r in rows), key=lambda r: (r[0], not r[1], r[3]))
    stems: dict[str, tuple[float, int]] = {}
    out, under = [], []
    for n, stem, minus, term, toxic in scored:
        above = [stems[term[:k]] for k in range(STEM[0], n + (not stem)) if term[:k] in stems]
        if any(-minus <= o + 0.5 for o, _ in above):
            if not stem and n >= EDIT_FROM:
                under.append((minus * np.sqrt(toxic), term, stem, 1))
            continue
        if stem:
            words = [r for r in scored if not r[1] and r[3].startswith(term)]
            if max((r[4] for r in words), default=0) >= 0.6 * toxic:  # one word stands behind it
                continue
            stems[term] = (-minus, toxic)
        edits = int(n >= (STEM_EDIT_FROM if stem else EDIT_FROM))
        out.append((minus * np.sqrt(toxic), term, stem, edits))
    return [x[1:] for x in sorted(out)[:LEXICON] + sorted(under)[:LEXICON]]


def learn(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, rows: int) -> Model:
    sample = F.broadcast(labelled(labels, "toxic", folds, held_out, rows))  # `rows` at most
    seen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(sample, "doc_id").select("text", "label")
    kinds = {r.label: r.n for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxics, cleans = kinds.get(1, 0), kinds.get(0, 0)
    share = toxics / (toxics + cleans) if toxics + cleans else 0.5
    if not toxics or not cleans:
        return Model([], np.zeros((0, 4)), None, share)
    counts = seen.mapInArrow(_terms, "term string, stem boolean, clean bigint, toxic bigint").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    chance = F.log((F.col("toxic") + 0.5) / (toxics + 1.0)) - F.log((F.col("clean") + 0.5) / (cleans + 1.0))
    telling = counts.filter((F.col("toxic") >= max(LEAST_DOCS, toxics // 200)) & (chance >= LEAST_ODDS)).orderBy(F.desc(chance * F.sqrt("toxic")), "term", "stem").limit(10 * LEXICON)
    terms = choose(telling.collect(), toxics, cleans)
    if not terms:
        return Model([], np.zeros((0, 4)), None, share)
    blank = Model(terms, np.zeros((len(terms), 4)), None, share)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in texts(batch.column("text")):
                number, of, found, quoted, reported = slice_hits(blank.automaton, part)
                cuts = np.searchsorted(of, np.arange(len(part) + 1))
                packed = [(found[a:b].astype(np.int64) * 4 + quoted[a:b] * 2 + reported[a:b]).tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, len(part)), pa.array(number, pa.int64()), pa.array(packed, pa.list_(pa.int64()))], names=["label", "n", "hits"])

    got = seen.mapInArrow(hits, "label int, n bigint, hits array<bigint>").toArrow()
    y, number = np.asarray(got["label"], np.float64), np.asarray(got["n"], np.int64)
    lists = got["hits"].combine_chunks()
    of = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths()))
    flat = np.asarray(lists.flatten(), np.int64)
    found, quoted, reported = flat >> 2, (flat >> 1 & 1).astype(bool), (flat & 1).astype(bool)
    pairs = np.unique(of.astype(np.int64) << 32 | found)
    term = pairs & 0xFFFFFFFF
    of_pair = (pairs >> 32).astype(int)
    size = 4 * len(terms)
    # each document's own part is left out of the weights that it is trained with
    t, c = np.bincount(term, y[of_pair], size), np.bincount(term, 1 - y[of_pair], size)
    weight = np.clip(odds(t, c, toxics, cleans), -2, 7).reshape(-1, 4)
    x = np.zeros((len(y), 8))
    fold = np.arange(len(y)) % 5
    for k in range(5):
        mine = fold[of_pair] == k
        tk, ck = t - np.bincount(term[mine], y[of_pair][mine], size), c - np.bincount(term[mine], 1 - y[of_pair][mine], size)
        wk = np.clip(odds(tk, ck, toxics * 0.8, cleans * 0.8), -2, 7)
        wk[(tk + ck) == 0] = 0
        now = fold[of] == k
        x[fold == k] = features(wk.reshape(-1, 4), number, of[now], found[now], quoted[now], reported[now])[fold == k]
    weight[(t + c).reshape(-1, 4) == 0] = 0
    return Model(terms, weight, logistic(x, y), share)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels, folds, held_out, rows)
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scorer(model), "doc_id bigint, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scorer(model: Model, keep: float | None = None):
    """A task's function: scores by document, or with `keep` the rows themselves whose score is below it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, part in texts(batch.column("text")):
                got, rows = model.score(part), batch.slice(i, len(part))
                if keep is not None:
                    yield rows.filter(pa.array(got < keep))
                else:
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(got)], names=["doc_id", "score"])

    return work


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held_out: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    return docs.mapInArrow(_scorer(learn(docs, labels, folds, held_out, rows), threshold), docs.schema)
