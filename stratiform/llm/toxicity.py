"""Toxicity by weak supervision.

Many voters look at a text: each entry of a lexicon of abuse, each learned word head, and patterns; a voter speaks for toxic or is
silent. A generative label model estimates by EM, without any label, how often each voter speaks in clean texts and in several kinds
of toxic ones; the kinds (about one a language) carry the correlation between voters. The posterior labels train a linear classifier on
the votes and on how many there are.

Labels of training rows are used for two things only: they choose the learned word heads (words beyond the fixed lexicon), and a last
logistic calibration of the one score. They don't vote.

Null and empty texts get the score of a text on which no voter fires; very long texts are read whole; a repeated row is scored each
time, and training rows that nearly repeat another count once. Of heads with the same odds the smaller wins. Without labelled rows the score tells
the fixed lexicon alone. An empty table gives an empty result. Other columns, whatever their names, may be kept.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, fit_logistic, fold, give_back, labelled_sample, logistic, named, slices, unused

PER_LABEL, MAX_CHARS, LEARNED_STEMS = 2048, 20_000, 1000
KINDS, LIFT = 8, 3.0
STEMS = (5, 6, 7, 99)  # bytes of a word's head; 99: the word itself

# Common terms of abuse.
LEXICON = """
idiot idiots moron morons stupid dumb dumbass loser losers trash garbage scum worthless pathetic disgusting clown fool imbecile
cretin bastard jerk freak creep pig filth vermin coward liar retard asshole bitch shit fuck crap hateful ugly
idiota imbécil estúpido basura asqueroso payaso idiotin trottel abschaum wertlos dummkopf arschloch widerlich
crétin ordure connard salaud minable dégoûtant abruti
""".split()
_SHOUT = re.compile(r"[A-Z]{4,}[ ,.]+[A-Z]{4,}|!!!")
_SECOND = re.compile(r"\byou(?:'re| are)\b|\bdu bist\b|\btu es\b|\beres\b", re.I)
_STRIP = bytes(c if 97 <= c <= 122 or c >= 128 or c == 39 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_STRIP).split()


class Voters:
    """What speaks on a text: lexicon entries, learned heads (word heads of STEMS bytes) and patterns."""

    PATTERNS = ("aimed", "shout_near")
    COUNTS = ("lexicon", "heads", "dense")

    def __init__(self, learned: dict[bytes, float] | None = None):
        lexicon = sorted({w.encode() for w in LEXICON})
        self.lexicon = {w: i for i, w in enumerate(lexicon)}
        self.stems = {w: len(lexicon) + i for i, w in enumerate(sorted(learned or {}))}
        self.words, self.heads = frozenset(self.lexicon), frozenset(self.stems)
        self.n = len(self.lexicon) + len(self.stems) + len(self.PATTERNS)
        self.names = [*(w.decode() for w in lexicon), *(f"{w.decode(errors='replace')}*" for w in self.stems), *self.PATTERNS]

    def votes(self, text: str | None) -> tuple[list[int], tuple[float, float, float]]:
        """The voters that speak, and log counts of lexicon words and heads and whether they are dense. Patterns vote on every text, whatever words it has."""
        text = text or ""
        words = words_of(text)
        different = set(words)
        lex = self.words & different
        stems = {h for n in STEMS for h in {w[:n] for w in different} & self.heads} if self.heads else set()
        on = [*(self.lexicon[w] for w in lex), *(self.stems[h] for h in stems)]
        on += [self.n - 2] * bool(_SECOND.search(text)) + [self.n - 1] * bool(_SHOUT.search(text))
        if not lex and not stems:
            return on, (0.0, 0.0, 0.0)
        n_lex = sum(w in lex for w in words)
        n_stem = sum(any(w[:n] in stems for n in STEMS) for w in words) if stems else 0
        return on, (math.log1p(n_lex), math.log1p(n_stem), float((n_lex + n_stem) * 100 > len(words)))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Votes (0 or 1), then the counts, a row for each text."""
        x = np.zeros((len(texts), self.n + len(self.COUNTS)))
        for i, t in enumerate(texts):
            on, x[i, self.n :] = self.votes(t)
            x[i, on] = 1
        return x


def different_rows(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Training rows without near copies, whose shared words would look like evidence: two minima of word-triple hashes, and neither seen before."""
    seen: list[set[int]] = [set(), set()]
    out = []
    for y, t in rows:
        words = words_of(t)
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        keys = [min(zlib.crc32(g, salt) for g in grams) for salt in (0, 1)]
        if not any(k in s for k, s in zip(keys, seen, strict=True)):
            out.append((y, t))
        for k, s in zip(keys, seen, strict=True):
            s.add(k)
    return out


def learn_stems(rows: list[tuple[int, str]], most: int = LEARNED_STEMS) -> dict[bytes, float]:
    """Word heads whose share of toxic texts no chance explains: log odds above 3.5, and a binomial surprise that holds for as many heads as there are."""
    tox, ok, n = Counter(), Counter(), Counter(y for y, _ in rows)
    for y, t in rows:
        different = set(words_of(t))
        (tox if y else ok).update({w[:k] for k in STEMS for w in different})
    share = n[1] / max(1, n[0] + n[1])
    if not 0 < share < 1:
        return {}
    needed = math.log(max(1, sum(c + ok[h] >= 3 for h, c in tox.items()))) + 4
    odds = {}
    for h, c in tox.items():
        z = math.log((c + 0.5) / (n[1] + 1) / ((ok[h] + 0.5) / (n[0] + 1)))
        k = c + ok[h]
        if z > 3.5 and -c * math.log(share) - (k - c) * math.log(1 - share) - math.lgamma(k + 1) + math.lgamma(c + 1) + math.lgamma(k - c + 1) > needed:
            odds[h] = z
    return dict(sorted(odds.items(), key=lambda x: (-x[1], x[0]))[:most])


class LabelModel:
    """A clean class and several kinds of toxic texts, in each of which voters speak at rates of their own; fitted by EM without labels.

    Kinds begin as groups of voters that speak together (lift above LIFT): voters are believed as far as others
    corroborate them. A voter's accuracy is the share of its votes that fall to toxic kinds, and voters' correlations are what
    the kinds have in common: within one kind they are independent.
    """

    def fit(self, votes: np.ndarray, weak: int = 0, rounds: int = 50) -> LabelModel:
        """The last `weak` voters begin no kind."""
        n, m = votes.shape
        rate = votes.mean(0)
        kinds = self.groups(votes[:, : m - weak])
        share = np.zeros((n, 1 + len(kinds)))
        for k, voters in enumerate(kinds):
            share[:, 1 + k] = votes[:, voters].sum(1)
        share[:, 0] = share[:, 1:].sum(1) == 0
        share = (share == share.max(1, keepdims=True)).astype(float)
        share /= share.sum(1, keepdims=True)
        for _ in range(rounds):
            size = share.sum(0)
            self.size = (size + 1) / (size.sum() + len(size))
            # half a row of what a voter does anywhere keeps rates off 0 and 1
            self.rate = np.clip((share.T @ votes + 0.5 * rate) / (size + 0.5)[:, None], 1e-6, 1 - 1e-6)
            share = self.kinds(votes)
        toxic = 1 - share[:, 0]
        self.accuracy = (toxic @ votes + 0.5) / (votes.sum(0) + 1)
        return self

    @staticmethod
    def groups(votes: np.ndarray) -> list[list[int]]:
        """The KINDS largest groups of voters that speak together, two voters at least."""
        n, m = votes.shape
        both, own = votes.T @ votes, votes.sum(0)
        tied = (both >= 3) & (both * n > LIFT * np.outer(own, own))
        group = np.arange(m)
        for i in range(m):
            for j in np.flatnonzero(tied[i, i + 1 :]) + i + 1:
                if group[i] != group[j]:
                    group[group == group[j]] = group[i]
        found = [np.flatnonzero(group == g).tolist() for g in np.unique(group)]
        return sorted((g for g in found if len(g) > 1), key=lambda g: (-own[g].sum(), g))[:KINDS]

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """The share of each kind in each text, the clean class first."""
        z = np.log(self.size) + votes @ np.log(self.rate).T + (1 - votes) @ np.log1p(-self.rate).T
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 - self.kinds(votes)[:, 0]


class ToxicityModel:
    def fit(self, rows: list[tuple[int, str]], share: float | None = None) -> ToxicityModel:
        """rows: (label, text); share: label 1 among all training labels, where rows is a sample balanced by label."""
        rows = different_rows(rows)
        self.voters = Voters(learn_stems(rows))
        self.weights, self.scale = None, np.array([1.0, 0.0])
        if not rows:
            return self
        x = self.voters.features([t for _, t in rows])
        votes = x[:, : self.voters.n]
        self.labels = LabelModel().fit(votes, weak=len(Voters.PATTERNS))
        self.weights = fit_logistic(x, self.labels.posterior(votes), l2=1e-4)
        y = np.array([r[0] for r in rows], float)
        if 0 < y.sum() < len(y):
            share = y.mean() if share is None else min(0.99, max(0.01, share))
            w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
            scale = fit_logistic(self._linear(x)[:, None], y, w, l2=1e-4)
            if scale[0] > 0:
                self.scale = scale
        return self

    def _linear(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -20, 20)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.array([0.9 if self.voters.words & set(words_of(t)) else 0.05 for t in texts])
        z = np.full(len(texts), self.weights[-1])
        for i, t in enumerate(texts):
            on, counts = self.voters.votes(t)
            z[i] += self.weights[on].sum() + self.weights[self.voters.n : -1] @ counts
        return logistic(np.clip(z, -20, 20) * self.scale[0] + self.scale[1])


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", mod: int = 5, out: int = 0) -> ToxicityModel:
    """Fits on a bounded sample of the training rows (PER_LABEL a label, MAX_CHARS a text)."""
    rows = labelled_sample(documents, labels, label, key=key, text=text, mod=mod, out=out, per_label=PER_LABEL, max_chars=MAX_CHARS)
    share = labels.where(fold(F.col(key), mod) != out).where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return ToxicityModel().fit([(y, t) for y, _, t in rows], share)


def score_documents(documents: DataFrame, model: ToxicityModel, *, text: str = "text", keep: list[str]) -> DataFrame:
    """`keep` columns of every row, then score; one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*named(*keep))
    at = unused(keep, "_text")

    def run(batches):
        for b in batches:
            for s in slices(b, at):
                got = shared.value.scores(s.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in keep), pa.array(got, pa.float64())], names=[*keep, "score"])
        give_back()

    return documents.select(*named(*keep), F.col(text).alias(at)).mapInArrow(run, ddl(kept, "score double"))
