"""Toxicity scores from a learned lexicon, Levenshtein automata and context windows.

Fit: from a bounded sample of labelled rows, near copies left out, the words that stand almost
only in toxic texts become the lexicon's terms and word beginnings that do so become its
stems. Score: for each word of a text the Levenshtein automaton of the word runs over the
trie of the lexicon, so misspelled terms are caught within one edit (two from nine letters
on). Each hit is judged by its window: inside quotation marks of any length, or near words
that report speech, it is a quotation, not abuse. A logistic model over the counts of exact, misspelled,
stem and quoted hits and the densest window gives the score; its prior carries what the
sample can't tell.

Only texts enter a score; ids, languages, sources and labels never do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import clear, in_slices, materialize
from millrace.llm._shingles import mix, shingle_sets

#: Bounds of the sample the model is fitted on: toxic and other rows. All terms that the sample supports are taken.
FIT_TOXIC, FIT_OTHER = 1500, 4500
#: A term must stand in so many toxic texts that chance gives that with at most this probability, in this many at least, and this share of its texts must be toxic.
MAX_CHANCE, MIN_TEXTS, MIN_SHARE = 2e-5, 4, 0.92
#: A stem must stand in so many times the toxic texts of any one term that begins with it.
STEM_GAIN = 1.25
#: Letters of the shortest and longest stem, and words on each side of a hit that make its window.
MIN_STEM, MAX_STEM, WINDOW = 4, 9, 6
#: Words each Python worker remembers the lexicon's answer for.
KNOWN_WORDS = 300_000

WORD = re.compile(r"\w+")
# Words that report what someone else said, in the languages of the corpus.
REPORTING = frozenset(
    "said says say called calls quoted quote quotes wrote writes word words term terms "
    "sagte sagt nannte zitat wort dit appelle cite mot dijo dice llama cita palabra".split()
)
# Quotation marks, and what ends a paragraph.
_MARKS = re.compile(r"[\"“”„«»]|\n[^\S\n]*\n\s*")

FEATURES = ("exact", "misspelled", "stem", "quoted", "densest")
# Where the sample says nothing of a feature its weight stays near this.
_PRIOR = np.array([-3.0, 4.0, 3.0, 3.0, -0.5, 1.0])
_PRIOR_SD = np.array([3.0, 2.0, 1.0, 2.0, 0.5, 1.0])


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """(opening mark, end) of the quotations of a text, of any length and over lines: one scan; sorted, none overlap.

    A mark after a space (or the start, or a bracket) and before a letter plainly opens, one
    after a letter and before none plainly closes; other straight marks do either in turn. A
    mark that plainly opens where one of its kind is open makes the earlier one a stray. A
    mark still open at the end of its paragraph is a stray too, unless the next paragraph
    starts with the same mark, as quotations of several paragraphs do.
    """
    spans = []
    opened: dict[str, tuple[int, str]] = {}  # place and mark of what is open, by kind
    for found in _MARKS.finditer(text):
        i, mark = found.start(), found[0]
        after = text[found.end() : found.end() + 1]
        if mark[0] == "\n":
            spans += [(at, i) for at, m in opened.values() if m == after]
            opened.clear()
            continue
        before = text[i - 1] if i else ""
        opens = (not before or before.isspace() or before in "([{") and after != "" and not after.isspace()
        closes = before != "" and not before.isspace() and not after.isalnum()
        kind = '"' if mark == '"' else "«" if mark in "«»" else "“"
        held = opened.get(kind)
        if mark == '"':
            ends, begins = held is not None and not opens, opens or not closes
        elif mark == "“":
            ends, begins = held is not None and held[1] == "„" and not opens, True
        else:
            ends, begins = held is not None and mark in "”»", mark in "„«"
        if ends:
            spans.append((opened.pop(kind)[0], i))
        elif begins:
            opened[kind] = (i, mark)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class LexiconTrie:
    """Terms in a trie, searched by the Levenshtein automaton of a word; stems beside it as a set of beginnings."""

    def __init__(self, terms: list[str], stems: list[str] = ()):
        self.stems = frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in stems})
        self.terms = frozenset(terms)
        self.root: dict = {}
        for term in terms:
            node = self.root
            for ch in term:
                node = node.setdefault(ch, {})
            node[""] = term
        self.heads: dict[int, set] = {}
        self.tails: dict[int, set] = {}
        self.fuzzy_sizes: set[int] = set()
        for term in terms:
            k = allowed_edits(term)
            if k:
                # k edits leave one of k + 1 parts whole; a part at an end stands at that end of the word.
                self.fuzzy_sizes.update(range(len(term) - k, len(term) + k + 1))
                if k == 1:
                    half = len(term) // 2
                    self.heads.setdefault(half, set()).add(term[:half])
                    self.tails.setdefault(len(term) - half, set()).add(term[half:])
                else:
                    third = len(term) // 3
                    for part in (term[:third], term[third : 2 * third], term[2 * third :]):
                        self.heads.setdefault(0, set()).add(part)
        self.parts = tuple(self.heads.pop(0, ()))

    def near(self, word: str) -> tuple[str, int] | None:
        """The term nearest to ``word`` within its allowed edits, and the edits; ties by term."""
        masks: dict[str, int] = {}
        for i, ch in enumerate(word):
            masks[ch] = masks.get(ch, 0) | (1 << i)
        accept = 1 << len(word)
        # State r is a set of bits: bit i says that i letters of the word are matched with r edits.
        start = (1, 3, 7)
        best: tuple[int, str] | None = None
        stack = [(self.root, start)]
        while stack:
            node, (s0, s1, s2) = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    edits = 0 if s0 & accept else 1 if s1 & accept else 2 if s2 & accept else 3
                    if edits <= allowed_edits(child) and (best is None or (edits, child) < best):
                        best = (edits, child)
                    continue
                m = masks.get(ch, 0)
                n0 = (s0 & m) << 1
                n1 = ((s1 & m) << 1) | s0 | (s0 << 1) | (n0 << 1)
                n2 = ((s2 & m) << 1) | s1 | (s1 << 1) | (n1 << 1)
                full = (accept << 1) - 1
                n1, n2 = n1 & full, n2 & full
                if n2:
                    stack.append((child, (n0, n1, n2)))
        return (best[1], best[0]) if best else None

    def kind(self, word: str) -> str | None:
        """exact, stem, misspelled or None."""
        if word in self.terms:
            return "exact"
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return "stem"
        if len(word) in self.fuzzy_sizes and (
            any(word[:n] in s for n, s in self.heads.items())
            or any(word[-n:] in s for n, s in self.tails.items())
            or any(p in word for p in self.parts)
        ):
            return "misspelled" if self.near(word) else None
        return None


@dataclass
class ToxicityModel:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    harmless: list[str] = field(default_factory=list)  #: spellings near a term that other texts use
    weights: list[float] = field(default_factory=lambda: _PRIOR.tolist())

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    def __init__(self, model: ToxicityModel):
        self.trie = LexiconTrie(model.terms, model.stems)
        self.weights = np.asarray(model.weights)
        self.harmless = frozenset(model.harmless)
        self.known: set[str] = set()
        self.bad: dict[str, str] = {}

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, str]]]:
        """The words of a text, and (place, kind) of those that the lexicon knows."""
        words = WORD.findall(text.lower())
        distinct = set(words)
        new = distinct - self.known
        if new:
            if len(self.known) + len(new) > KNOWN_WORDS:
                self.known.clear()
                self.bad.clear()
                new = distinct
            kind = self.trie.kind
            for w in new:
                k = kind(w)
                if k and w not in self.harmless:
                    self.bad[w] = k
            self.known |= new
        bad = self.bad
        if bad.keys().isdisjoint(distinct):
            return words, []
        return words, [(i, bad[w]) for i, w in enumerate(words) if w in bad]

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        words, hits = self.hits(text)
        if not hits:
            return [0.0] * len(FEATURES)
        low = text.lower()
        spans = quoted_spans(low)
        opening = [a for a, _ in spans]
        starts = [m.start() for m in WORD.finditer(low)] if spans else []
        counts = dict.fromkeys(FEATURES, 0.0)
        abuse = []
        for i, kind in hits:
            span = bisect_right(opening, starts[i]) - 1 if spans else -1
            in_quotes = span >= 0 and starts[i] < spans[span][1]
            told = not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW])
            if in_quotes or told:
                counts["quoted"] += 1
            else:
                counts[kind] += 1
                abuse.append(i)
        if abuse:
            at = np.asarray(abuse)
            counts["densest"] = float((np.searchsorted(at, at + 2 * WINDOW, side="right") - np.arange(len(at))).max() - 1)
        return [float(np.log1p(counts[f])) for f in FEATURES]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return 1.0 / (1.0 + float(np.exp(-z)))


def fit_weights(x: np.ndarray, y: np.ndarray, share: float) -> list[float]:
    """Posterior mode of a logistic model; rows are weighted back to ``share`` toxic ones."""
    x1 = np.column_stack((np.ones(len(x)), x))
    rate = y.mean() if len(y) else 0.5
    weight = np.where(y == 1, share / max(rate, 1e-9), (1 - share) / max(1 - rate, 1e-9))
    beta = _PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        grad = x1.T @ (weight * (y - p)) - (beta - _PRIOR) / _PRIOR_SD**2
        hess = (x1 * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(1 / _PRIOR_SD**2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return np.round(beta, 6).tolist()


def _distinct_rows(spark, sample: DataFrame) -> list[int]:
    """Ids of the sample without near copies: a row that shares any of 8 minima of its shingles with an earlier one goes."""

    def run(batches):
        seeds = mix(np.arange(1, 9, dtype=np.uint64))
        for batch in in_slices(batches):
            rows = [mix(h[None, :] ^ seeds[:, None]).min(1).astype(np.int64).tolist() if len(h) else [] for h in shingle_sets(batch.column(1), 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["id", "minima"])

    seen: set[tuple[int, int]] = set()
    kept = []
    for r in sorted(sample.select("id", "text").mapInArrow(run, "id long, minima array<long>").collect(), key=lambda r: r["id"]):
        mins = set(enumerate(r["minima"]))
        if not mins & seen:
            kept.append(r["id"])
            seen |= mins
    return kept


def _counts(sample: DataFrame, stems: bool) -> DataFrame:
    """(term, toxic, other): texts of either label in which a word, or a word with that beginning, stands."""

    def run(batches):
        for batch in in_slices(batches):
            got: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = set(WORD.findall((text or "").lower()))
                if stems:
                    found = {w[:n] for w in found for n in range(MIN_STEM, min(len(w), MAX_STEM + 1))}
                for w in found:
                    got.setdefault(w, [0, 0])[1 - label] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(got), pa.string()), pa.array([v[0] for v in got.values()], pa.int64()), pa.array([v[1] for v in got.values()], pa.int64())],
                names=["term", "toxic", "other"],
            )

    return sample.select("text", "label").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )


def _chosen(counts: DataFrame, least: int) -> dict[str, int]:
    """The terms that tell toxic texts from others, with the toxic texts of each.

    Each stands in ``least`` of the sample's toxic texts at least, which bounds them by the
    words of FIT_TOXIC texts.
    """
    good = counts.where((F.col("toxic") >= least) & (F.col("toxic") >= MIN_SHARE * (F.col("toxic") + F.col("other"))))
    return {r["term"]: r["toxic"] for r in good.orderBy(F.desc("toxic"), "term").collect()}


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> ToxicityModel:
    """A model from at most FIT_TOXIC + FIT_OTHER rows of ``labels`` for which ``learnable`` holds.

    The rows with the smallest hashes are taken. Without any labelled row, or with empty
    tables, the model is the prior with an empty lexicon. Rows with null ids or labels are not
    used; null and empty texts have no words; an id that repeats in ``labels`` counts once, as
    toxic if any row says so, and one that repeats in ``docs`` for each text; other columns are not read.
    """
    spark, spent = docs.sparkSession, []
    known = labels.where(learnable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("label")
    )
    known = known.groupBy("lid").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    if share is None:
        return ToxicityModel()
    pick = lambda v, n: known.where(F.col("label") == v).orderBy(F.xxhash64("lid"), "lid").limit(n)
    ids = materialize(pick(1, FIT_TOXIC).unionByName(pick(0, FIT_OTHER)), "toxicity-ids", spent=spent)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(narrow.join(F.broadcast(ids), F.col("id") == F.col("lid")).select("id", "text", "label"), "toxicity-sample", spent=spent)
    kept = spark.createDataFrame([(i,) for i in _distinct_rows(spark, sample)], "kid long")
    distinct = materialize(sample.join(F.broadcast(kept), F.col("id") == F.col("kid")).select("text", "label"), "toxicity-distinct", spent=spent)
    base = distinct.agg(F.avg("label")).first()[0] or 0.5
    least = max(MIN_TEXTS, int(np.ceil(np.log(MAX_CHANCE) / np.log(min(max(base, 1e-3), 0.9)))))
    whole = _chosen(_counts(distinct, stems=False), least)
    stems: list[str] = []
    for stem, n in sorted(_chosen(_counts(distinct, stems=True), least).items(), key=lambda s: (len(s[0]), s[0])):
        known_term = max((c for t, c in whole.items() if t.startswith(stem)), default=0)
        if n >= STEM_GAIN * known_term and not any(stem.startswith(s) for s in stems):
            stems.append(stem)
    # Terms that begin with a stem stay in the trie: a misspelling inside the stem is near them alone.
    terms = list(whole)
    trie = LexiconTrie(terms, stems)

    def near(batches):
        for batch in in_slices(batches):
            found = {w for t in batch.column(0).to_pylist() for w in WORD.findall((t or "").lower())}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(w for w in found if trie.kind(w) == "misspelled"), pa.string())], names=["word"])

    harmless = distinct.where("label = 0").select("text").mapInArrow(near, "word string").distinct()
    # Bounded by the words of FIT_OTHER texts that are near a term.
    model = ToxicityModel(terms, stems, sorted(r["word"] for r in harmless.collect()))

    def run(batches):
        scorer = model.scorer()
        for batch in in_slices(batches):
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    rows = distinct.mapInArrow(run, "x array<double>, label int").collect()
    rows.sort(key=lambda r: (r["label"], r["x"]))
    clear(spark, spent)
    if rows:
        model.weights = fit_weights(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]), share)
    return model


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; predicted is 1 from 0.5 on. One map-only pass.

    Defined results: a null, empty or wordless text has the score of a text without hits; a
    null id stays null; repeated rows each give a row with equal scores; an empty table gives
    none; other columns are not read.
    """

    def run(batches):
        scorer = model.scorer()
        for batch in in_slices(batches):
            s = [round(scorer.score(t), 9) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "score", "predicted"]
            )

    narrow = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text isn't predicted toxic; same columns.

    Defined results: null, empty and wordless texts have no hits and stay, unless the model's
    bias alone says toxic; null ids and repeated rows are judged by their texts like any other;
    an empty table gives an empty one; other columns, of whatever name, are passed on. One
    map-only pass; memory follows the longest text.
    """
    fields = df.schema

    def run(batches):
        scorer = model.scorer()
        for batch in in_slices(batches):
            i = batch.schema.get_field_index(text_col)
            keep = [scorer.score(t) < 0.5 for t in batch.column(i).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, fields)


def held_out(id_col: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 0 modulo 5. A null id isn't held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
