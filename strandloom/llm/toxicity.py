"""Toxicity scores: Levenshtein automata meet a lexicon trie, context windows tell quotation from abuse.

The lexicon is learned: words and word beginnings that are much more frequent in documents labelled toxic than in
others, beyond what chance gives, counted over all labelled documents of the training rows. A text's words are matched against the trie of
the lexicon by walking it together with the word's Levenshtein automaton, so a misspelled term is found at
one edit without listing its misspellings. Each hit is weighted by its context window: inside quotation marks or next to
a word of reporting it speaks of abuse rather than being it. A logistic model over a few features of
the hits turns them into a score; it is fitted on at most ``FIT_ROWS`` training documents, those with the smallest hashes.

Most texts have no hit. Which have is found by the distinct words of a slice of texts, of which those that were looked at
lately are known by their hash; only texts with a hit are walked through word by word.
"""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.shingles import SLICE, slices, span_hashes
from strandloom.session import materialize

FIT_ROWS = 20_000
MIN_DOCS, MIN_SHARE, MIN_RATIO, MAX_CHANCE = 5, 0.01, 10.0, 1e-6
FLUSH_TERMS = 500_000
STEM_CHARS = tuple(range(8, 2, -1))
FUZZY_CHARS = 5
WINDOW = 4
#: words that a Python worker remembers having looked at
KNOWN_WORDS = 1 << 19

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‹›"
# Words that report speech rather than address someone.
REPORTING = frozenset("said says saying quote quoted quotes called calling wrote writes word term phrase dit sagte schrieb dijo".split())

#: bytes that may be in a word: ASCII letters and figures, and all bytes of other characters
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")

FEATURES = ("bias", "term_hits", "stem_hits", "quoted_hits", "weight", "density")


class Trie:
    """Lexicon terms as nested dicts; ``""`` marks the end of a term with (term, weight)."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.root: dict = {}
        for term, weight in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (term, weight)

    def near(self, word: str) -> tuple[str, float, int] | None:
        """The nearest term at most one edit away, as (term, weight, edits); of equally near ones the first by letters.

        The word's Levenshtein automaton is walked along the trie. Bit i of ``none`` and ``one`` says that the path so far
        equals the word's first i letters, without and with one edit; bit i of ``swap`` that the path's last letter is the
        word's letter i + 1, so that letter i may follow. A branch ends where no bit is left.
        """
        places: dict[str, int] = {}
        for i, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << i
        full, best = 1 << len(word), None
        stack = [(self.root, 1, 2, 0)]
        while stack:
            node, none, one, swap = stack.pop()
            if (none | one) & full and "" in node:
                found = (*node[""], 0 if none & full else 1)
                if best is None or (found[2], found[0]) < (best[2], best[0]):
                    best = found
            # once the edit is made only the word's own letters lead on
            letters = node if none else [c for c in {word[i] for i in range(len(word)) if (one | swap) >> i & 1} if c in node]
            for c in letters:
                if c == "":
                    continue
                at = places.get(c, 0)
                exact = (none & at) << 1
                edited = (one & at) << 1 | none | none << 1 | exact << 1 | (swap & at) << 2
                swapped = none & at >> 1
                if exact | edited | swapped:
                    stack.append((node[c], exact, edited & (full << 1) - 1, swapped))
        return best


def shortened(word: str) -> list[str]:
    """The word, and the word without each one of its letters: words one edit or swap apart have one of these in common."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Scorer:
    """Features of whole texts under a lexicon of words and stems; ``benign`` forms are no misspellings."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], benign: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.benign = words, stems, benign
        fuzzy = {w: v for w, v in words.items() if len(w) >= FUZZY_CHARS}
        self.trie = Trie(fuzzy)
        self.shortened = {s for w in fuzzy for s in shortened(w)}
        self.misspelled: dict[str, tuple[float, int] | None] = {}
        self.lengths = {len(w) + k for w in fuzzy for k in (-1, 0, 1)}
        self.heads = {s[: min(STEM_CHARS)] for s in stems}
        # hashes of words that were looked at, each in its slot, and whether they are hits
        self.seen, self.hit = np.zeros(KNOWN_WORDS, np.uint64), np.zeros(KNOWN_WORDS, bool)

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, kind) of a word: kind 0 exact, 1 misspelled, 2 stem."""
        if word in self.words:
            return self.words[word], 0
        if word[: min(STEM_CHARS)] in self.heads:
            for n in STEM_CHARS:
                if len(word) > n and word[:n] in self.stems:
                    return self.stems[word[:n]], 2
        if len(word) not in self.lengths or self.shortened.isdisjoint(shortened(word)) or word in self.benign:
            return None
        if word not in self.misspelled:
            if len(self.misspelled) > KNOWN_WORDS:
                self.misspelled.clear()
            found = self.trie.near(word)
            self.misspelled[word] = found and (found[1], 1)
        return self.misspelled[word]

    def features(self, text: str, among: set[str] | None = None) -> list[float]:
        """Features of a text, word by word; only words in ``among``, if given, can be hits."""
        lowered, n = text.lower(), 0
        counts, weight, known = [0, 0, 0], 0.0, {}  # terms, stems, quoted ones
        before: deque[tuple[str, int]] = deque(maxlen=WINDOW)
        for m in WORD.finditer(lowered):
            word, n = m.group(), n + 1
            if word not in known:
                known[word] = self.match(word) if among is None or word in among else None
            if known[word] is not None:
                value, kind = known[word]
                if self._quoted(lowered, before, m):
                    counts[2] += 1
                    value *= 0.3
                else:
                    counts[kind == 2] += 1
                weight += value
            before.append((word, m.start()))
        return [1.0, *(math.log1p(c) for c in counts), math.log1p(weight), min(1.0, 20 * sum(counts) / max(1, n))]

    def features_of(self, texts: list[str]) -> np.ndarray:
        """[texts, features]; those of texts without a hit are all zero but for the bias."""
        rows = np.zeros((len(texts), len(FEATURES)))
        rows[:, 0] = 1.0
        found, words = self.with_hits(texts)
        for i in np.flatnonzero(found):
            rows[i] = self.features(texts[i], words)
        return rows

    def with_hits(self, texts: list[str]) -> tuple[np.ndarray, set[str]]:
        """Whether each text has a hit, and the words of all texts that may be hits."""
        raw = [t.encode() for t in texts]
        if len(raw) != 1 or len(raw[0]) <= 2 * SLICE:
            return self._with_hits(raw)
        at, found, words = 0, False, set()  # a long text in pieces that don't break words
        while at < len(raw[0]):
            gap = BREAK.search(raw[0], at + SLICE)
            end = gap.end() if gap else len(raw[0])
            here, more = self._with_hits([raw[0][at:end]])
            found, at = found or bool(here[0]), end
            words |= more
        return np.array([found]), words

    def _with_hits(self, texts: list[bytes]) -> tuple[np.ndarray, set[str]]:
        joined = b" ".join([b"", *texts, b""]).lower()
        data = np.frombuffer(joined, np.uint8)
        inside = WORD_BYTES[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, after = edges[::2], edges[1::2]
        names, one, which = np.unique(span_hashes(data, first, after), return_index=True, return_inverse=True)
        slot = (names & np.uint64(KNOWN_WORDS - 1)).astype(np.int64)
        known, hit = self.seen[slot] == names, self.hit[slot]

        def words(k: int) -> list[str]:
            run = joined[first[one[k]] : after[one[k]]].decode()
            return [run] if run.isascii() else WORD.findall(run.lower())

        for k in np.flatnonzero(~known).tolist():
            hit[k] = any(map(self.match, words(k)))
        self.seen[slot], self.hit[slot] = names, hit
        owner = np.searchsorted(np.cumsum([1, *(len(t) + 1 for t in texts)]), first, "right") - 1
        return np.bincount(owner, hit[which], minlength=len(texts)) > 0, {w for k in np.flatnonzero(hit).tolist() for w in words(k)}

    @staticmethod
    def _quoted(text: str, before: deque[tuple[str, int]], m: re.Match) -> bool:
        """Whether the window around a word has it in quotation marks or reports speech."""
        left = before[0][1] if before else m.start()
        right = max((w.end() for w in itertools.islice(WORD.finditer(text, m.end()), WINDOW)), default=m.end())
        opened = any(c in QUOTES for c in text[max(0, left - 1) : m.start()])
        closed = any(c in QUOTES for c in text[m.end() : right + 1])
        return opened and closed or any(w in REPORTING for w, _ in before)


@functools.lru_cache(maxsize=2)
def _scorer(words: tuple, stems: tuple, benign: frozenset[str]) -> Scorer:
    """One scorer to a Python worker: what it remembers of words serves the worker's later tasks too."""
    return Scorer(dict(words), dict(stems), benign)


def _in_order(terms: dict[str, float]) -> tuple[tuple[str, float], ...]:
    """Terms in an order of their own, so that ties between near terms fall alike in every run."""
    return tuple(sorted(terms.items()))


def held_out(id_col: str) -> Column:
    """Rows of the test fold: those whose crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def stems_of(words: set[str]) -> set[str]:
    """The distinct beginnings of the longer words."""
    return {w[:n] for w in words for n in STEM_CHARS if len(w) > n}


def _count_terms(batches: Iterator[pa.RecordBatch], only: frozenset[tuple[bool, str]] | None) -> Iterator[pa.RecordBatch]:
    """(stem, term, n): in how many of a task's texts each term (or each of ``only``) is."""
    counts: Counter = Counter()
    words_only, stems_only = ({t for stem, t in only or () if stem == kind} for kind in (False, True))
    heads = {t[: min(STEM_CHARS)] for t in stems_only}

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.bool_()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["stem", "term", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in slices(batch, "body"):
            for text in part.column("body").to_pylist():
                words = set(WORD.findall(text.lower()))
                if only is None:
                    stems = stems_of(words)
                else:
                    stems = stems_of({w for w in words if w[: min(STEM_CHARS)] in heads}) & stems_only
                    words &= words_only
                counts.update((False, w) for w in words)
                counts.update((True, w) for w in stems)
            if len(counts) > FLUSH_TERMS:
                yield flush()
    yield flush()


def by_chance(hits: int, others: int, share: float) -> float:
    """A bound on the probability that of all texts with a term as many are toxic, if toxic ones have it as often (Chernoff)."""
    n = hits + others
    p = hits / n
    if p <= share:
        return 1.0
    return math.exp(-n * (p * math.log(p / share) + (others and (1 - p) * math.log((1 - p) / (1 - share)))))


def learn_lexicon(training: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with log ratios, from all rows of ``training`` (body, toxic).

    A term must be in ``MIN_DOCS`` toxic documents and ``MIN_SHARE`` of them, be ``MIN_RATIO`` times as frequent there as
    in the others, and be so by chance with a probability of at most ``MAX_CHANCE``. That share bounds what the driver
    gets by a text's distinct terms over ``MIN_SHARE``, whatever the corpus.
    """
    totals = training.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = totals["n"] or 0, int(totals["toxic"] or 0)
    if not toxic or toxic == n:
        return {}, {}

    def counted(rows: DataFrame, only: frozenset | None) -> DataFrame:
        parts = rows.select("body").mapInArrow(lambda b: _count_terms(b, only), "stem boolean, term string, n long")
        return parts.groupBy("stem", "term").agg(F.sum("n").alias("n"))

    least = max(MIN_DOCS, math.ceil(MIN_SHARE * toxic))
    hits = {(r["stem"], r["term"]): r["n"] for r in counted(training.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    clean = {(r["stem"], r["term"]): r["n"] for r in counted(training.where("toxic = 0"), frozenset(hits)).collect()}
    hits = {k: h for k, h in hits.items() if by_chance(h, clean.get(k, 0), toxic / n) <= MAX_CHANCE}
    score = {k: math.log((h + 0.5) / (toxic + 1)) - math.log((clean.get(k, 0) + 0.5) / (n - toxic + 1)) for k, h in hits.items()}
    words = {t: v for (stem, t), v in score.items() if not stem and v >= math.log(MIN_RATIO)}
    # a beginning that is there because of one word says no more than the word
    of_word: Counter = Counter()
    for w in words:
        for length in STEM_CHARS:
            if len(w) > length:
                of_word[w[:length]] = max(of_word[w[:length]], hits[False, w])
    stems = {t: v for (stem, t), v in score.items() if stem and v >= math.log(MIN_RATIO) and hits[True, t] > 1.2 * of_word[t]}
    return words, stems


def learn_benign(training: DataFrame, words: dict[str, float], stems: dict[str, float]) -> frozenset[str]:
    """Forms one edit from a term that aren't misspellings of it, as clean texts have them too.

    Counted over all of ``training``; there are at most as many as the terms have neighbours.
    """
    known_words, known_stems = _in_order(words), _in_order(stems)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = _scorer(known_words, known_stems, frozenset()), Counter()
        for batch in batches:
            for part in slices(batch, "body"):
                texts, marks = part.column("body").to_pylist(), part.column("toxic").to_pylist()
                found, words = scorer.with_hits(texts)
                forms = {w for w in words if (scorer.match(w) or (0, 0))[1] == 1}
                for i in np.flatnonzero(found).tolist():
                    counts.update((w, marks[i]) for w in forms.intersection(WORD.findall(texts[i].lower())))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["form", "toxic", "n"])

    forms = training.select("body", "toxic").mapInArrow(count, "form string, toxic int, n long").groupBy("form").pivot("toxic", [0, 1]).agg(F.sum("n"))
    totals = training.groupBy().pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).first()
    clean, toxic = (totals[c] or 0 for c in ("0", "1"))
    ratio = (F.coalesce("1", F.lit(0)) + 0.5) / (toxic + 1) / ((F.col("0") + 0.5) / (clean + 1))
    return frozenset(r["form"] for r in forms.where((F.col("0") > 0) & (ratio < MIN_RATIO)).select("form").collect())


#: coefficients where nothing could be learned: every text is clean
CLEAN = np.array([-5.0] + [0.0] * (len(FEATURES) - 1))


def fit(features: np.ndarray, labels: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method."""
    coef = np.zeros(features.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ coef, -30, 30)))
        gradient = features.T @ (p - labels) + l2 * coef
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + l2 * np.eye(len(coef)), gradient)
        coef -= step
        if np.abs(step).max() < 1e-8:
            break
    return coef


def _probability(rows: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(rows @ coef, -30, 30)))


def _score(batches: Iterator[pa.RecordBatch], lexicon: tuple, coef: np.ndarray) -> Iterator[pa.RecordBatch]:
    scorer = _scorer(*lexicon)
    for batch in batches:
        for part in slices(batch, "body"):
            score = _probability(scorer.features_of(part.column("body").to_pylist()), coef)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[dict, dict, frozenset, np.ndarray]:
    """(words, stems, benign forms, coefficients) from the labelled rows outside the test fold.

    Rows with null labels or ids are not used; of several labels of one id the largest counts.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    marks = marks.where(~held_out("doc_id"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).where(~held_out("doc_id"))
    # both sides are shuffled at every size: labels grow with the corpus
    training = materialize(texts.join(marks.hint("merge"), "doc_id"), "toxicity-training")
    words, stems = learn_lexicon(training)
    benign = learn_benign(training, words, stems) if words else frozenset()
    lexicon = _in_order(words), _in_order(stems), benign
    if not words and not stems:
        return words, stems, benign, CLEAN
    thin = max(1, training.count() // FIT_ROWS)
    sample = training.where(F.pmod(F.xxhash64("doc_id"), F.lit(thin)) == 0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*lexicon)
        for batch in batches:
            for part in slices(batch, "body"):
                made = scorer.features_of(part.column("body").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *map(pa.array, made.T)], ["doc_id", "toxic", *FEATURES])

    made = sample.select("doc_id", "toxic", "body").mapInArrow(rows, "doc_id long, toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    table = made.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", *FEATURES).limit(FIT_ROWS).toPandas()
    coef = fit(table[list(FEATURES)].to_numpy(float), table["toxic"].to_numpy(float))
    return words, stems, benign, coef


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores depend on the text alone. Defined results: null and empty texts score as texts without hits; repeated
    rows score alike; where no term can be learned, as without labels of both kinds, every text is clean and scores
    alike, below 0.5; an empty table gives no rows; other columns are not read.
    """
    words, stems, benign, coef = train(docs, labels, id_col, text_col, label_col)
    lexicon = _in_order(words), _in_order(stems), benign
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(lambda b: _score(b, lexicon, coef), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with all their columns; texts don't leave their partition.

    Without usable labels all rows stay. Null ids and repeated rows are scored like any other.
    """
    words, stems, benign, coef = train(docs, labels, id_col, text_col, label_col)
    lexicon, at = (_in_order(words), _in_order(stems), benign), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(*lexicon)
        for batch in batches:
            for part in slices(batch, at):
                rows = scorer.features_of([t or "" for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(_probability(rows, coef) < threshold))

    return docs.mapInArrow(clean, docs.schema)
