"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context-window scores.

Training (labelled rows only): grouped counts of words and word beginnings in toxic and clean texts give a
lexicon of terms whose log odds are high at their lower confidence bound and whose share of toxic rows can't be chance: were a term's
rows drawn at random, so many toxic ones would come up with probability below ``CHANCE`` for any of all candidate terms together
(an upper bound of the binomial tail). So how rare a term may be depends on the evidence alone. Of near copies among the labelled
rows one counts. The terms form a trie. The
Levenshtein automaton of every term (0, 1 or 2 edits, by its length; a beginning allows none) is run on the
trie at once: its states are sets of (trie node, edits). It runs on the branches of those terms only whose length and set of letters
differ from the word's by no more than the term's edits can explain; so the result is that of the whole trie and most words need no run. Each hit is weighed by a window of tokens round it: quotation marks
round it or a word of mention nearby make it a quoted hit. A text's features are those of its worst ``SPAN`` words, whatever its length, and a logistic
model of them gives the score; quoted evidence can lower a score but not raise it.

Words of any length are looked up, and three or more single letters with signs between them also as one word.
Spellings near a term that clean training texts use are no misspellings. Bounds, all parameters: at most
``sample`` labelled rows (those of smallest hash), at most ``terms`` terms (the most significant) and ``sample`` clean spellings.

Defined cases: null or empty text scores as a text without hits; a text of any length scores as its worst window; repeated rows score alike
and train once; an empty table gives an empty result; terms that tie are taken in order of their letters. Rows whose label is null don't train. Labels
without one of the two classes give the constant score of the share of toxic rows. A null doc_id is the empty
text in crc32. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.common import U64, byte_texts, crc_mod, crc_mod_py, lean, mix, pieces, raw, shingle_sets

SAMPLE, TERMS, STEMS, WINDOW, THRESHOLD, LEAST, CHANCE = 50_000, 4096, (4, 9), 5, 0.3, 3, 0.5
#: Words of a scored window.
SPAN = 40
#: Fixed word list: words of mention, in the languages of the tables.
MENTION = frozenset("quote quoted word words term slur called says said writes wrote mot mots terme dit wort wörter begriff sagte palabra palabras término dijo".split())
_WORD = re.compile(r"\w+")
_SPELT = re.compile(r"(?<!\w)\w(?:[^\w\s]\w){2,}(?!\w)")
_SEEDS = mix(np.arange(1, 6, dtype=U64) * U64(0x9E3779B97F4A7C15))
_OPENERS = "\"'“”„«»‘’`"


def joined(lower: str) -> str:
    """The text with letters that only signs part ("i.d.i.o.t") put together."""
    return _SPELT.sub(lambda m: "".join(_WORD.findall(m[0])), lower)


def _terms_of(text: str) -> set[tuple[str, int]]:
    """(term, kind): kind 1 for words, 0 for beginnings of longer words."""
    words = set(_WORD.findall(joined(text.lower())))
    found = {(w, 1) for w in words}
    for w in words:
        for k in range(STEMS[0], min(STEMS[1], len(w))):
            found.add((w[:k], 0))
    return found


def _count_terms(batches):
    for batch in batches:
        counts: dict[tuple[str, int], list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for term in _terms_of(text or ""):
                counts.setdefault(term, [0, 0])[toxic] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["term", "kind", "clean", "toxic"])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A set of letters (code points modulo 64) and a length for each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.bitwise_or.reduceat(U64(1) << (codes & np.uint32(63)).astype(U64), np.cumsum(sizes) - sizes), sizes


@dataclass
class Lexicon:
    """Terms, their kind and weight, as a trie with the automaton of all terms and edits.

    ``clean``: spellings near a term that clean training texts use; they are words of their own, not misspellings.
    """

    terms: list[tuple[str, int, float]]
    clean: frozenset[str] = frozenset()
    next: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[list[int]] = field(default_factory=lambda: [[]])
    most: list[int] = field(default_factory=lambda: [0])

    def __post_init__(self) -> None:
        self.paths: list[list[int]] = []  # trie nodes of each term
        self.whole: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        for i, (term, kind, _) in enumerate(self.terms):
            node, allowed = 0, self.edits(term, kind)
            path = [0]
            self.most[0] = max(self.most[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], allowed)
                path.append(node)
            self.ends[node].append(i)
            self.paths.append(path)
            (self.whole if kind else self.stems)[term] = i
        self.memo: dict[str, tuple[int, int] | None] = {}
        self.lengths = sorted({len(x) for x in self.stems})
        self.starts = {x[: self.lengths[0]] for x in self.stems}
        loose = [i for x, i in self.whole.items() if self.edits(x, 1)]
        masks, sizes = _letters([self.terms[i][0] for i in loose]) if loose else (np.empty(0, U64), np.empty(0, np.int64))
        self.loose = list(zip(loose, masks, sizes.tolist()))  # words that allow edits, their letters and lengths

    @staticmethod
    def edits(term: str, kind: int) -> int:
        return 0 if kind == 0 or len(term) < 5 else 1 if len(term) < 9 else 2

    def near(self, words: list[str]) -> dict[str, list[int]]:
        """The lexicon's words that can be within their edits of each word, by length and letters: an edit brings in and
        takes out one letter at most. Words without any are left out."""
        found: dict[str, list[int]] = {}
        if not any(words) or not self.loose:
            return found
        words = sorted(filter(None, words), key=len)
        masks, sizes = _letters(words)
        for i, letters, size in self.loose:
            e = self.edits(*self.terms[i][:2])
            a, b = np.searchsorted(sizes, (size - e, size + e + 1))
            part = masks[a:b]
            for k in np.flatnonzero((np.bitwise_count(part & ~letters) <= e) & (np.bitwise_count(letters & ~part) <= e)).tolist():
                found.setdefault(words[a + k], []).append(i)
        return found

    def _closed(self, pairs: set[tuple[int, int]], nodes: set[int]) -> list[tuple[int, int]]:
        """Add letters left out, then keep only the fewest edits of each node that some term below allows."""
        best: dict[int, int] = {}
        stack = list(pairs)
        while stack:
            node, e = stack.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            stack += [(child, e + 1) for child in self.next[node].values() if child in nodes]
        return list(best.items())

    def _step(self, pairs: list[tuple[int, int]], c: str, nodes: set[int]) -> list[tuple[int, int]]:
        to: set[tuple[int, int]] = set()
        for node, e in pairs:
            to.add((node, e + 1))
            for letter, child in self.next[node].items():
                if child in nodes:
                    to.add((child, e + (letter != c)))
        return self._closed(to, nodes)

    def lookup(self, word: str, near: list[int] | None = None) -> tuple[int, int] | None:
        """(term, edits) of the best term for a word: fewest edits, then largest weight; edits -1 for a beginning."""
        if word in self.whole:
            return self.whole[word], 0
        if near is None:
            near = self.near([word]).get(word, [])
        best = None
        if near:
            nodes = {node for i in near for node in self.paths[i]}
            pairs = self._closed({(0, 0)}, nodes)
            for c in word:
                pairs = self._step(pairs, c, nodes)
                if not pairs:
                    break
            for node, e in pairs:
                for i in self.ends[node]:
                    term, kind, weight = self.terms[i]
                    if kind == 1 and e <= self.edits(term, kind):
                        best = min(best or (9, 0.0, 0), (e, -weight, i))
        if self.lengths and word[: self.lengths[0]] in self.starts:
            stem = max((k for k in self.lengths if word[:k] in self.stems and k <= len(word)), default=0)
            if stem:
                return self.stems[word[:stem]], -1
        return (best[2], best[0]) if best and word not in self.clean else None

    def hits(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """The words that match a term, and what they match."""
        memo = self.memo
        new = words.difference(memo)
        if new:
            if len(memo) + len(new) > 200_000:
                self.memo = memo = {x: memo[x] for x in words if x in memo}
            near = self.near(list(new))
            for w in new:
                memo[w] = self.lookup(w, near.get(w, []))
        return {w: hit for w in words if (hit := memo[w]) is not None}

    def features_of(self, texts: list[str | None]) -> list[list[float]]:
        """features() of many texts; their words are looked up together."""
        out = []
        for i in range(0, len(texts), 200):
            lower = [joined((t or "").lower()) for t in texts[i : i + 200]]
            words = [set(_WORD.findall(t)) for t in lower]
            hits = self.hits(set().union(*words))
            none = hits.keys().isdisjoint
            out += [[0.0, 0.0, 0.0, 1.0] if none(w) else self._weighed(t, hits) for t, w in zip(lower, words)]
        return out

    def features(self, text: str) -> list[float]:
        """Saturated evidence of plain and of quoted hits in their worst windows, number of plain hits in one, and 1. Each edit costs 30 % of a term's weight."""
        return self.features_of([text])[0]

    def _weighed(self, lower: str, hits: dict[str, tuple[int, int]]) -> list[float]:
        places = list(_WORD.finditer(lower))
        found: tuple[list[tuple[int, float]], list[tuple[int, float]]] = ([], [])  # (place, evidence) of plain and of quoted hits
        for k, m in enumerate(places):
            if m[0] not in hits:
                continue
            term, edits = hits[m[0]]
            round_it = {places[x][0] for x in range(max(0, k - WINDOW), min(len(places), k + WINDOW + 1)) if x != k}
            left, right = lower[max(0, m.start() - 1) : m.start()], lower[m.end() : m.end() + 1]
            quoted = bool(left and left in _OPENERS and right and right in _OPENERS) or not MENTION.isdisjoint(round_it)
            found[quoted].append((k, self.terms[term][2] * 0.7 ** max(0, edits)))
        (plain, n), (quoted_evidence, _) = map(worst_window, found)
        return [math.log1p(plain), math.log1p(quoted_evidence), math.log1p(100 * n / SPAN), 1.0]


def worst_window(found: list[tuple[int, float]], span: int = SPAN) -> tuple[float, int]:
    """Largest evidence and largest number of hits within ``span`` words, of hits (place, evidence) in order."""
    most, many, total, first = 0.0, 0, 0.0, 0
    for k, (place, evidence) in enumerate(found):
        total += evidence
        while found[first][0] <= place - span:
            total -= found[first][1]
            first += 1
        most, many = max(most, total), max(many, k - first + 1)
    return most, many


def tail(a: int, b: int, share: float) -> float:
    """Upper bound of the logarithm of P(at least a of a + b rows are toxic) if each is with chance ``share`` (Chernoff)."""
    n, q = a + b, a / (a + b)
    if q <= share:
        return 0.0
    return -n * (q * math.log(q / share) + ((1 - q) * math.log((1 - q) / (1 - share)) if b else 0.0))


def choose_terms(counts: list[tuple[str, int, int, int]], clean: int, toxic: int, candidates: int, most: int = TERMS) -> list[tuple[str, int, float]]:
    """Lexicon terms from (term, kind, clean rows, toxic rows): significant among all ``candidates``, without what a chosen beginning covers."""
    scored, least = [], math.log(CHANCE / max(1, candidates))
    for term, kind, b, a in counts:
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if a >= LEAST and weight > 2.2 and weight - 2.5 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) > 0.7 and tail(a, b, toxic / (clean + toxic)) < least:
            scored.append((-a, kind == 0, -len(term), term, kind, weight))
    chosen, covered, told = [], set(), {}
    for a, _, _, term, kind, weight in sorted(scored):
        starts = [term[:k] for k in range(STEMS[0], len(term) + 1)]
        if not covered.isdisjoint(starts) or kind == 0 and -a - told.get(term, 0) < 5:
            continue
        if kind == 0:
            covered.add(term)
        for x in starts:
            told[x] = told.get(x, 0) - a
        chosen.append((term, kind, weight))
    return chosen[:most]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; the last feature is the constant and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: list[tuple[str, int, float]]
    weights: list[float]
    clean: frozenset[str] = frozenset()

    def scorer(self):
        """Scores of a list of texts."""
        lexicon, w = Lexicon(self.terms, self.clean), np.array(self.weights)
        return lambda texts: (1 / (1 + np.exp(-np.clip(np.array(lexicon.features_of(texts)).reshape(-1, 4) @ w, -30, 30)))).tolist()


def _min_keys(batches):
    for batch in batches:
        data, offsets = raw(byte_texts(batch.column("text")))
        for i, j in pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            keys = [[int(mix(s ^ seed).min()) >> 1 if len(s) else 0 for s in sets] for seed in _SEEDS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("toxic").slice(i, j - i), *[pa.array(k, pa.int64()) for k in keys]], names=["doc_id", "toxic", *[f"k{n}" for n in range(len(_SEEDS))]])


def one_of_each(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic) of one row of each group of near copies with one label, as the words of a text copied a
    thousand times are no thousand findings. Rows that share a least shingle hash count as copies; a round for each hash."""
    names = [f"k{n}" for n in range(len(_SEEDS))]
    left = rows.mapInArrow(lean(_min_keys), "doc_id long, toxic int, " + ", ".join(f"{n} long" for n in names))
    for n in names:
        left = left.groupBy("toxic", n).agg(F.min(F.struct("doc_id", *[x for x in names if x != n])).alias("r")).select("toxic", n, "r.*")
    return left.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, held_out=None, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learn from rows of ``docs`` with a label in ``labels`` (doc_id, toxic) for which ``held_out(column name)`` is false."""
    held_out = held_out or (lambda c: crc_mod(c, 4) == 2)
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = labelled.join(F.broadcast(one_of_each(labelled.join(F.broadcast(known), "doc_id"))), "doc_id").select("text", "toxic").persist()
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not toxic:
        rows.unpersist()
        return Model([], [0.0] * 3 + [30.0 if toxic else -30.0])
    counted = rows.mapInArrow(lean(_count_terms), "term string, kind int, clean long, toxic long").groupBy("term", "kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.filter(F.col("toxic") >= LEAST).persist()
    candidates = counted.count()
    likely = counted.filter(F.expr(f"(toxic + 0.5) / {toxic + 1} > (clean + 0.5) / {clean + 1} * 1.6"))
    best = likely.orderBy(F.desc(F.expr(f"ln((toxic + 0.5) / {toxic + 1} / ((clean + 0.5) / {clean + 1})) - 2.5 * sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))")), "term", "kind").limit(8 * terms)
    chosen = choose_terms([tuple(r) for r in best.select("term", "kind", "clean", "toxic").collect()], clean, toxic, candidates, terms)
    counted.unpersist()

    def near(batches):
        lexicon = Lexicon(chosen)
        for batch in batches:
            words = set().union(*(_WORD.findall(joined((text or "").lower())) for text in batch.column("text").to_pylist()))
            found = {w for w, hit in lexicon.hits(words).items() if hit[1] > 0}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["w"])

    if not chosen:
        near_clean: frozenset[str] = frozenset()
    else:
        near_clean = frozenset(r["w"] for r in rows.filter("toxic = 0").mapInArrow(near, "w string").groupBy("w").count().orderBy(F.desc("count"), "w").limit(SAMPLE).collect())

    def features(batches):
        lexicon = Lexicon(chosen, near_clean)
        for batch in batches:
            found = lexicon.features_of(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = rows.mapInArrow(features, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    rows.unpersist()
    repeat = np.array([r["count"] for r in got])
    x, y = np.repeat(np.array([r["x"] for r in got]), repeat, axis=0), np.repeat(np.array([r["toxic"] for r in got], float), repeat)
    weights = _logistic(x, y)
    if weights[1] > 0:  # quoted evidence raises no score
        weights = np.insert(_logistic(np.delete(x, 1, axis=1), y), 1, 0.0)
    return Model(chosen, [float(v) for v in weights], near_clean)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""

    def scored(batches):
        scorer = model.scorer()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            marks = scorer(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([crc_mod_py(i, 4) == 2 for i in ids], pa.bool_()), pa.array(marks, pa.float64()), pa.array([int(m >= THRESHOLD) for m in marks], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(scored), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, all columns."""

    def kept(batches):
        scorer = model.scorer()
        for batch in batches:
            keep = [x < THRESHOLD for x in scorer(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(kept), docs.schema)
