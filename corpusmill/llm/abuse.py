"""Abusive, hateful and sexual content, by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney trigram models over words, one of abusive and one of ordinary sentences, are trained on a
bounded sample of rated documents; below their own unigrams both back off to one shared distribution of continuation
counts, so a rare word costs either class the same. Ratings hold for documents while abuse sits in single sentences, and
some ratings are wrong: training begins with the sentences of documents rated abusive whose words tell of it, then re-assigns
the sentences of all sampled documents by the two models for ROUNDS rounds, each by the counts of all other sentences.

A passage's score is the difference of the two log-likelihoods a word, in natural logarithms. Transcripts have no
sentence ends, so each line's best window of at most WINDOW words counts beside its sentences. A document's score is
that of its worst passage; it is flagged at THRESHOLD or more.

Words are compared in lower case with look-alike digits and signs inside words undone, single spaced letters joined,
numbers as one word and handles as one word.

Defined results: null and empty texts score 0 and are not flagged; documents without ratings are scored like others;
without any rating of either kind every score is 0; repeated rows of one doc_id keep one score each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import attached, cut

#: Rated documents of each kind that the models are fitted on at most, chosen by hash, none longer than SAMPLE_CHARS.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 20_000
ROUNDS = 4
WINDOW = 10
LEAST_WORDS = 2
#: A word tells of abuse, for the first round, below this share of ordinary documents and above so many times its share
#: there among abusive ones; a sentence begins as abusive with this share of such words.
TELLING_RATE, TELLING_LIFT, TELLING_SHARE = 0.02, 4, 0.34
DISCOUNT = 0.75
THRESHOLD = 0.75

_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"})
_TOKEN = re.compile(r"@\w+|[^\W\d_](?:[\w$@*!'’-]*[\w$*])?|\d[\w$@*!-]*[^\W\d_][\w$@*!]*|\d+")
_SENTENCE = re.compile(r"(?<=[.!?])[\s\"')\]]+")
_PREFIX = re.compile(r"^\s*(?:[>*#|-]+\s*|\d+[.)]\s+|[A-Z][\w ]{0,14}:\s+|\*\*[^*]{1,20}\*\*\s*)+")


class _Forms(dict):
    """The compared form of each token, kept."""

    def __missing__(self, t: str) -> str:
        if len(self) > 300_000:
            self.clear()
        if t[0] == "@":
            form = "<at>"
        elif t.isdigit():
            form = "<n>"
        else:
            form = t.lower().translate(_LOOKALIKE) if any(c in "013457$@!" for c in t) else t.lower()
        self[t] = form
        return form


_FORMS = _Forms()


def tokens(text: str) -> list[str]:
    out = [_FORMS[t] for t in _TOKEN.findall(text)]
    if sum(len(t) == 1 for t in out) < 3:
        return out
    joined: list[str] = []
    i = 0
    while i < len(out):  # s p a c e d letters
        j = i
        while j < len(out) and len(out[j]) == 1:
            j += 1
        if j - i >= 3:
            joined.append("".join(out[i:j]))
            i = j
        else:
            joined.append(out[i])
            i += 1
    return joined


def passages(text: str | None) -> Iterator[list[str]]:
    """The words of each sentence of each line."""
    for line in (text or "").split("\n"):
        for part in _SENTENCE.split(_PREFIX.sub("", line)):
            words = tokens(part)
            if len(words) >= LEAST_WORDS:
                yield words


class Model:
    """Interpolated Kneser-Ney of two classes over a shared base; `weights` are fractional counts of the sentences."""

    def __init__(self, sentences: list[tuple[tuple[str, ...], float]]):
        tri = (defaultdict(float), defaultdict(float))
        types: Counter = Counter()
        pairs: set = set()
        for words, toxic in sentences:
            padded = ("<s>", "<s>", *words)
            for i in range(2, len(padded)):
                gram = padded[i - 2 : i + 1]
                if toxic < 1:
                    tri[0][gram] += 1 - toxic
                if toxic > 0:
                    tri[1][gram] += toxic
                if gram[1:] not in pairs:
                    pairs.add(gram[1:])
                    types[gram[2]] += 1
        self.shared, self.shared_n, self.words = dict(types), sum(types.values()), len(types) + 1
        self.levels = [self._levels(t) for t in tri]

    @staticmethod
    def _levels(tri: dict) -> list[tuple[dict, dict, dict]]:
        """For orders 3, 2 and 1: counts, the context's sum, and the context's number of continuations."""
        out = []
        # continuation counts: of a bigram the kinds of words before it, of a word the kinds of bigrams; fractions below 1 stay
        two: dict = defaultdict(float)
        for g, n in tri.items():
            two[g[1:]] += min(n, 1.0)
        one: dict = defaultdict(float)
        for g, n in two.items():
            one[g[1:]] += min(n, 1.0)
        for counts in (tri, two, one):
            sums, kinds = defaultdict(float), defaultdict(float)
            for g, n in counts.items():
                sums[g[:-1]] += n
                kinds[g[:-1]] += min(n, DISCOUNT)
            out.append((dict(counts), dict(sums), dict(kinds)))
        return out

    def _p(self, c: int, gram: tuple, own: float = 0.0, orders: tuple = (2, 1, 0)) -> float:
        """P(last word | words before it); `own` is a weight of this gram's to leave out of the counts."""
        p = (self.shared.get(gram[2], 0) + 1.0) / (self.shared_n + self.words)
        rest = self.levels[c][0][0].get(gram, 0.0) - own
        below = own if rest <= 0 else 0.0  # counts of kinds lose one only when the last of its kind goes
        for order in orders:  # 0: the trigram, 2: the word alone
            counts, sums, kinds = self.levels[c][order]
            context = gram[order:2]
            less = below if order else own
            total = sums.get(context, 0.0) - less
            if total > 0:
                n = counts.get(gram[order:], 0.0) - less
                # 1 is added to the sum: a context seen a fraction of a time says little
                p = (max(n - DISCOUNT, 0.0) + (kinds[context] + 1.0) * p) / (total + 1.0)
        return p

    def _ratio(self, gram: tuple, own: tuple[float, float] = (0.0, 0.0)) -> float:
        r = math.log(self._p(1, gram, own[1]) / self._p(0, gram, own[0]))
        last = self.levels[1][0][0].get(gram, 0.0) - own[1] <= 0
        if self.levels[1][1][0].get(gram[1:], 0.0) - (own[1] if last else 0.0) <= 0:
            # the smaller model's contexts give up more mass to unseen words: without evidence for the pair only the word speaks
            r = min(r, math.log(self._p(1, gram, own[1], (2,)) / self._p(0, gram, own[0], (2,))))
        return r

    def _seen(self, gram: tuple, low: dict) -> float:
        """`_ratio` with nothing left out; what the last two words and the last word give is kept in `low`."""
        pair, word = gram[1:], gram[2:]
        known = low.get(pair)
        if known is None:
            if len(low) > 400_000:
                low.clear()
            one = low.get(word)
            if one is None:
                one = low[word] = tuple(self._step(c, 2, word, (self.shared.get(gram[2], 0) + 1.0) / (self.shared_n + self.words)) for c in (0, 1))
            known = low[pair] = (*(self._step(c, 1, pair, one[c]) for c in (0, 1)), math.log(one[1] / one[0]) if self.levels[1][1][0].get(pair, 0.0) <= 0 else None)
        r = math.log(self._step(1, 0, gram, known[1]) / self._step(0, 0, gram, known[0]))
        return r if known[2] is None else min(r, known[2])

    def _step(self, c: int, order: int, gram: tuple, p: float) -> float:
        """One order of interpolation over the lower orders' probability `p`."""
        counts, sums, kinds = self.levels[c][order]
        total = sums.get(gram[:-1], 0.0)
        return (max(counts.get(gram, 0.0) - DISCOUNT, 0.0) + (kinds[gram[:-1]] + 1.0) * p) / (total + 1.0) if total > 0 else p

    def without(self, words: tuple[str, ...], toxic: float, memo: dict) -> float:
        """The sentence's log-ratio by the counts of all other sentences; `toxic` is its own weight."""
        padded, total = ("<s>", "<s>", *words), 0.0
        for i in range(2, len(padded)):
            key = (padded[i - 2 : i + 1], toxic)
            r = memo.get(key)
            if r is None:
                r = memo[key] = self._ratio(key[0], (1 - toxic, toxic))
            total += r
        return total

    def score(self, words: tuple[str, ...], memo: Ratios) -> float:
        """The best of the sentence's and its windows' log-ratio a word."""
        r = [memo[g] for g in zip(("<s>", "<s>", *words), ("<s>", *words), words)]
        best = sum(r) / max(len(r), 4)
        if len(r) > WINDOW:
            sums = list(accumulate(r, initial=0.0))
            for size in (5, WINDOW):
                best = max(best, max(map(sub, sums[size:], sums)) / size)
        return best


class Ratios(dict):
    """The log-ratio toxic to ordinary of each trigram's last word by one model, kept."""

    def __init__(self, model: Model):
        self.model, self.low = model, {}

    def __missing__(self, gram: tuple) -> float:
        if len(self) > 400_000:
            self.clear()
        r = self[gram] = self.model._seen(gram, self.low)
        return r


def fit(rated: list[tuple[str | None, float]]) -> Model | None:
    """From (text, share of ratings that say abusive)."""
    docs = [([tuple(w) for w in passages(t)], y) for t, y in rated]
    if not any(y > 0.5 for _, y in docs) or not any(y <= 0.5 for _, y in docs):
        return None
    inside = [Counter(), Counter()]
    sizes = [0, 0]
    for sentences, y in docs:
        sizes[y > 0.5] += 1
        inside[y > 0.5].update({w for s in sentences for w in s})

    def telling(w: str) -> bool:
        """The word is rare in ordinary documents and comes several times as often in abusive ones."""
        ordinary, toxic = ((inside[c][w] + 0.5) / (sizes[c] + 1) for c in (0, 1))
        return ordinary < TELLING_RATE and toxic > TELLING_LIFT * ordinary

    def start(s: tuple[str, ...]) -> bool:
        return sum(map(telling, s)) >= TELLING_SHARE * len(s)

    weights = [[float(y > 0.5 and start(s)) for s in sentences] for sentences, y in docs]
    model = None
    for _ in range(ROUNDS):
        model = Model([(s, w) for (sentences, _), ws in zip(docs, weights) for s, w in zip(sentences, ws)])
        memo: dict = {}
        prior = [math.log(0.3) if y > 0.5 else math.log(0.04) for _, y in docs]
        weights = [
            [1 / (1 + math.exp(-max(-30, min(30, p + model.without(s, w, memo))))) for s, w in zip(sentences, ws)]
            for (sentences, _), p, ws in zip(docs, prior, weights)
        ]
        weights = [[0.0 if w < 0.02 else 1.0 if w > 0.98 else w for w in ws] for ws in weights]
    return model


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The sample is chosen among ratings, so that only the texts of rated documents are looked at and none is moved but theirs."""
    rated = cut(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("rate")))
    texts = documents.filter(F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", "text")
    held = attached(texts, rated, ["doc_id"], F.lit(16)).dropDuplicates(["doc_id"]).withColumn("h", F.xxhash64("doc_id"))
    sample = [held.filter(c).orderBy("h", "doc_id").limit(SAMPLE_DOCS) for c in (F.col("rate") > 0.5, F.col("rate") <= 0.5)]
    return fit([(r.text, r.rate) for r in sample[0].unionByName(sample[1]).select("text", "rate", "h", "doc_id").collect()])


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, flagged) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        memo = Ratios(model) if model else None
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                best = 0.0
                if model:
                    best = -99.0
                    for words in passages(text):
                        key = tuple(words)
                        s = known.get(key)
                        if s is None:
                            if len(known) > 100_000:
                                known.clear()
                            s = known[key] = model.score(key, memo)
                        best = max(best, s)
                    best = best if best > -99 else 0.0
                out.append(best)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["doc_id", "source", "score"])

    return (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id long, source string, score double")
        .withColumn("flagged", F.col("score") >= THRESHOLD)
    )


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(documents, labels).filter("flagged").select("doc_id")


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """For each source (null too) the documents, those flagged and their share."""
    return (
        scores(documents, labels).groupBy("source")
        .agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"), F.avg(F.col("flagged").cast("int")).alias("rate"))
    )
