"""Language identification of mixed-language text.

A word's script (fixed code-point ranges) leaves the learned languages that use
it as candidates; character trigrams score the word under each; a Viterbi pass
with a penalty for switching labels the words, so that a text falls into spans
of one language. A text's language is the one whose spans have most letters.

The model is fitted on the driver on a bounded sample of labelled rows: of each
language, however many there are, about ``TRAIN_DOCS`` documents of at most
``TRAIN_CHARS`` characters, or as many as keep its share of ``TRAIN_TOTAL``
characters for all languages, chosen by a hash of the id among all labelled
rows. Prediction reads nothing but the text, whole texts, and runs without a
shuffle.

Defined results: null text or text without a letter is ``und`` with score 0;
letters of scripts no learned language uses count for none; a text with only
such letters gets the commonest learned language with score 0; without any
labelled row everything is ``und``. Of labels that cost the same a word keeps
the one before it, else takes the language that sorts first; so does a text of
which two languages hold equally many letters. Texts of any length are labelled
whole; every row is answered by itself, repeated ids included; other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, kept

#: Documents sampled for each language, about (a hash threshold sets it).
TRAIN_DOCS = 300
#: Longest document that the sample takes, in characters.
TRAIN_CHARS = 20_000
#: Characters that the sample of all languages takes, about.
TRAIN_TOTAL = 60_000_000
#: Cost of a switch, in nats.
SWITCH = 6.0
#: A word moves the decision by this many nats at most.
WORD_NATS = 12.0
#: Share of a language's training letters from which it counts as using a script.
SCRIPT_SHARE = 0.01
#: Words labelled together.
BATCH_WORDS = 250_000
#: Words whose scores a worker keeps at most.
KEPT = 200_000

#: First code points of script ranges, in order; what lies between has the name given.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Cherokee"),
    (0x1780, "Khmer"),
    (0x1800, "Mongolian"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Latin"),
    (0x2E80, "Han"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0x3130, "Hangul"),
    (0x3190, "Han"),
    (0xA000, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Latin"),
    (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"),
    (0xFF00, "Latin"),
    (0xFF66, "Kana"),
    (0xFFA0, "Hangul"),
    (0x10000, "Other"),
    (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPTS]
_ASCII_RUNS = re.compile("[a-zA-Z]+")


def script(letter: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(letter)) - 1][1]


def letter_runs(token: str) -> list[str]:
    """The runs of letters of a token, cut also where the script changes."""
    if token.isascii():
        return [token] if token.isalpha() else _ASCII_RUNS.findall(token)
    out, now, of = [], [], ""
    for c in token:
        kind = script(c) if c.isalpha() else ""
        if kind != of and now:
            out.append("".join(now))
            now = []
        of = kind
        if kind:
            now.append(c)
    if now:
        out.append("".join(now))
    return out


class Model:
    """Trigram log-probabilities and scripts of the learned languages."""

    def __init__(self, samples: list[tuple[str, str]]):
        grams: dict[str, Counter] = defaultdict(Counter)
        scripts: dict[str, Counter] = defaultdict(Counter)
        docs = Counter(lang for lang, _ in samples)
        for lang, text in samples:
            for word, n in Counter(text.lower().split()).items():
                for run in letter_runs(word):
                    padded = f" {run} "
                    scripts[lang][script(run[0])] += n * len(run)
                    for k in range(len(padded) - 2):
                        grams[lang][padded[k : k + 3]] += n
        self.languages = sorted(docs)
        self.common = max(self.languages, key=lambda x: (docs[x], x), default="und")
        vocabulary = len({g for c in grams.values() for g in c}) + 1
        totals = [sum(grams[x].values()) + vocabulary for x in self.languages]
        self.unseen = np.array([-math.log(t) for t in totals], np.float64)
        # row 0 is an unseen trigram
        rows = [np.array(self.unseen)]
        self.grams: dict[str, int] = {}
        for g in sorted({g for c in grams.values() for g in c}):
            self.grams[g] = len(rows)
            rows.append(np.log([grams[x][g] + 1.0 for x in self.languages]) + self.unseen)
        self.table = np.array(rows).reshape(len(rows), len(self.languages))
        self.users: dict[str, int] = {}
        uses = []
        for s in sorted({s for c in scripts.values() for s in c}):
            use = [scripts[x][s] >= SCRIPT_SHARE * max(1, sum(scripts[x].values())) for x in self.languages]
            if any(use):
                self.users[s] = len(uses)
                uses.append(use)
        self.uses = np.array(uses, bool).reshape(len(uses), len(self.languages))
        self.token = uuid.uuid4().hex

    def words(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of tokens under each language (at most 0), their letters, and those with a candidate."""
        n, get = len(tokens), self.grams.get
        total, letters, known = np.zeros((n, len(self.languages))), np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[int] = []
        sizes, owner, user = [], [], []
        for k, token in enumerate(tokens):
            for run in letter_runs(token):
                letters[k] += len(run)
                of = self.users.get(script(run[0]))
                if of is None:
                    continue
                known[k] += len(run)
                padded = f" {run} "
                found += [get(padded[i : i + 3], 0) for i in range(len(run))]
                sizes.append(len(run))
                owner.append(k)
                user.append(of)
        if sizes:
            begin = np.cumsum(sizes) - sizes
            runs = np.add.reduceat(self.table[np.array(found)], begin, axis=0)
            runs[~self.uses[np.array(user)]] -= 1e6
            np.add.at(total, np.array(owner), runs)
        if len(self.languages):
            total -= total.max(axis=1, keepdims=True)
        return np.maximum(total, -WORD_NATS), letters, known


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; scores are (words, languages), texts one after the other.

    All texts step together: step t takes word t of each text that has one.
    """
    n_lang = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    ordered = lengths[order]
    steps = int(ordered[0]) if len(ordered) else 0
    active = np.searchsorted(-ordered, -np.arange(steps), side="left")
    labels = np.zeros(len(scores), np.int16)
    came = np.zeros(len(scores), np.int16)
    moved = np.zeros(scores.shape, bool)
    value = np.zeros((len(ordered), n_lang))
    for t in range(steps):
        k = active[t]
        v, at = value[:k], starts[:k] + t
        if t:
            best = v.argmax(axis=1)
            jump = v[np.arange(k), best] - switch
            came[at] = best
            change = v < jump[:, None]
            moved[at] = change
            v = np.where(change, jump[:, None], v)
        value[:k] = v + scores[at]
    now = value.argmax(axis=1) if n_lang else np.zeros(len(ordered), int)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = np.where(moved[at, now[:k]], came[at], now[:k])
    return labels


class Labeller:
    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))
        self.letters = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        parts = [self.model.words(fresh[lo : lo + 20_000]) for lo in range(0, len(fresh), 20_000)]
        self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh)), strict=True))
        self.scores, self.letters, self.known = (
            np.concatenate([old, *(p[k] for p in parts)]) for k, old in enumerate((self.scores, self.letters, self.known))
        )

    def label(self, texts: list[str]):
        """Yield (language, score, [(language, first word, end word)]) for each text."""
        if len(self.numbers) > KEPT:
            self.reset()
        own = [t.lower().split() for t in texts]
        fresh = set().union(*own).difference(self.numbers)
        if fresh:
            self.learn(list(fresh))
        lengths = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(own)), np.int64, int(lengths.sum()))
        names = self.model.languages
        labels = viterbi(self.scores[ids], lengths) if names else np.zeros(len(ids), int)
        letters, known = self.letters[ids], self.known[ids]
        at = 0
        for n in lengths.tolist():
            part, mine, counted = labels[at : at + n], letters[at : at + n], known[at : at + n]
            at += n
            total = int(mine.sum())
            if not total or not names:
                yield "und", 0.0, []
                continue
            share = np.bincount(part, counted, len(names))
            best = int(share.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
            spans = [(names[part[a]], a, b) for a, b in zip(cuts, cuts[1:])]
            yield (names[best] if share[best] else self.model.common), float(share[best]) / total, spans


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the bounded sample of the labelled rows given."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30))
    sizes = rows.groupBy(lang_col).agg(F.count("*").alias("n"), F.sum(F.length(text_col)).alias("chars"), F.min(draw).alias("first")).collect()
    if not sizes:
        return Model([])
    share = TRAIN_TOTAL / len(sizes)
    # no language is left without a document
    below = {r[0]: max(r["first"] + 1, min(1 << 30, int((1 << 30) * min(TRAIN_DOCS / r["n"], share / max(1, r["chars"]))) + 1)) for r in sizes}
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])[F.col(lang_col)]
    sample = rows.where(draw < limit).select(F.col(lang_col), F.col(text_col)).collect()
    return Model(sorted((r[0], r[1]) for r in sample))


def labeller_of(model: Model) -> Labeller:
    """A worker's labeller of a model, kept from task to task."""
    return kept(("langid", model.token), lambda: Labeller(model))


_SPAN = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (language, first and end white-space word) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = labeller_of(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            lo, size = 0, 0
            for k in range(len(texts)):
                size += len(texts[k]) // 6 + 1
                if size >= BATCH_WORDS or k == len(texts) - 1:
                    out = list(labeller.label(texts[lo : k + 1]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[lo : k + 1], pa.int64()),
                            pa.array([x[0] for x in out], pa.string()),
                            pa.array([x[1] for x in out], pa.float64()),
                            pa.array([[{"lang": a, "first_word": b, "end_word": c} for a, b, c in x[2]] for x in out], pa.list_(_SPAN)),
                        ],
                        names=["doc_id", "lang_pred", "score", "spans"],
                    )
                    lo, size = k + 1, 0

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(frugal(run, "langid"), "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,first_word:bigint,end_word:bigint>>")
    return made.withColumnRenamed("doc_id", id_col)


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a language that holds min_score of its letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = labeller_of(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            keep: list[bool] = []
            lo, size = 0, 0
            for k in range(len(texts)):
                size += len(texts[k]) // 6 + 1
                if size >= BATCH_WORDS or k == len(texts) - 1:
                    keep += [lang != "und" and score >= min_score for lang, score, _ in labeller.label(texts[lo : k + 1])]
                    lo, size = k + 1, 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run, "langid"), docs.schema)
