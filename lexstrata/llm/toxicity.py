"""Toxicity by a weighted finite-state pattern grammar.

The lexicon is a weighted transducer that reads words letter by letter: it accepts whole
words and stems, weighted by how much likelier they are in labelled toxic texts than in the
others (log odds of document frequency). Function words of negation, reported speech,
targets and threats are listed below. It is composed with the clause grammar
(:mod:`.transducers`), which tells plain, negated, quoted and aimed insults and threats
apart by what stands before and behind them; a text's features are the lexicon weights it
matched by kind and its worst clause, and a logistic model with a prior for kinds that the
labels do not show turns them into a score.

Learning uses at most about ``sample`` labelled texts, chosen by a hash of the id; scoring
covers every whole text. Labels, language, source and id are never features.

Defined cases: a null or empty text gets the score of a text without a match; a null id is
scored like any other row and never learnt from; rows that repeat an id are scored one by
one; labels that are null are ignored; without any usable labels all scores are 0; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc_mod, materialize
from .transducers import END, INSULT, NEGATED, NEGATION, PLAIN, QUOTED, REPORT, TARGET, TARGETED, THREAT, THREATENED, Lexicon, clause_grammar

SAMPLE = 20_000
THRESHOLD = 0.3
STEMS = (4, 5, 6, 7, 8)
MIN_TEXTS = 4
CAUTION = 1.0
STEM_SPREAD = 1.3
MIN_SHARE = 0.004
MIN_WEIGHT = 2.5
THREAT_WEIGHT = 2.0
_ENDS = frozenset(".!?;:\n")
_PIECES = re.compile(r"[^\W\d_]+|[.!?;:\n]")

# Function words of the clause grammar in English, German, French and Spanish.
NEGATIONS = "not no never nor neither nicht kein keine nie niemals pas jamais aucun ni nunca jamás tampoco"
REPORTS = "said says wrote quoted claimed called sagte schrieb zitierte nannte dit écrivit cita appela dijo escribió citó llamó"
TARGETS = "you your yours they them he she him her du dich dir ihr euch sie tu te toi vous eux tú ti usted ustedes ellos ellas"
THREATS = "kill hurt destroy beat burn shoot töten schlagen vernichten verbrennen tuer frapper détruire brûler matar golpear destruir quemar"
KINDS = (PLAIN, NEGATED, QUOTED, TARGETED, THREATENED)
# Prior of the logistic model: intercept, a factor for each kind, the worst clause, all but the strongest match.
PRIOR = (-4.0, 1.0, 0.4, 0.4, 1.2, 1.0, 0.5, 0.5)


def _function_words() -> dict[str, str]:
    lists = ((THREATS, THREAT), (TARGETS, TARGET), (REPORTS, REPORT), (NEGATIONS, NEGATION))
    return {w: symbol for words, symbol in lists for w in words.split()}


def lexicon_paths(word: str) -> list[str]:
    """Paths of a word through the lexicon: its stems, marked with *, and the word."""
    return [word[:n] + "*" for n in STEMS if len(word) > n] + [word]


class Scorer:
    """Matches of the lexicon composed with the clause grammar, and the model's score."""

    CACHE = 400_000

    def __init__(self, lexicon: dict[str, float], model: tuple[float, ...]):
        self.lexicon, self.model = lexicon, model
        self.letters, self.grammar = Lexicon(lexicon, _function_words()), clause_grammar()
        self.cache: dict[str, tuple[str, float]] = {}

    def read(self, word: str) -> tuple[str, float]:
        """(class, weight) of a word: the way of each word through the lexicon is remembered.
        A threat verb has a weight of its own."""
        if word in _ENDS:
            return END, 0.0
        symbol, weight = self.letters.read(word)
        return symbol, THREAT_WEIGHT if symbol == THREAT else weight

    def clauses(self, text: str) -> Iterator[tuple[str, list[float]]]:
        """Kinds and weights of each clause with an insult or a threat."""
        if len(self.cache) > self.CACHE:
            self.cache.clear()
        cache, symbols, weights, open_ = self.cache, [], [], False
        for piece in _PIECES.findall(text.lower() + "\n"):
            got = cache.get(piece)
            if got is None:
                got = cache[piece] = self.read(piece)
            symbol, weight = got
            symbols.append(symbol)
            weights.append(weight)
            open_ = open_ or symbol == INSULT or symbol == THREAT
            if symbol == END:
                if open_:
                    yield self.grammar.run("".join(symbols)), weights
                symbols, weights, open_ = [], [], False

    def features(self, text: str | None) -> list[float]:
        """1, log(1 + matched weight) of each kind, of the worst clause, and of all matches but
        the strongest: one rare word alone says little."""
        totals = dict.fromkeys(KINDS, 0.0)
        worst = strongest = 0.0
        for kinds, weights in self.clauses(text or ""):
            found = [(k, w) for k, w in zip(kinds, weights, strict=True) if k in totals]
            for kind, weight in found:
                totals[kind] += weight
                strongest = max(strongest, weight)
            worst = max(worst, sum(w for _, w in found))
        return [1.0, *(math.log1p(totals[k]) for k in KINDS), math.log1p(worst), math.log1p(sum(totals.values()) - strongest)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, allowed, sample: int) -> DataFrame:
    """(id, text, y) of about ``sample`` labelled rows at most, chosen by a hash of the id."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y is not null").filter(allowed("id"))
    usable = usable.groupBy("id").agg(F.max("y").alias("y"))
    n = usable.count()
    if n > sample:
        usable = usable.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    chosen = usable.sparkSession.createDataFrame(usable.collect(), usable.schema)  # about `sample` rows of two integers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(rows.join(F.broadcast(chosen), "id"), "labelled")


def learn_lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Weighted paths from half 0, from half 1, and from all of the labelled texts.

    Equal texts count once. A weight is a cautious log odds: toxic counts are taken low and
    clean counts high by ``CAUTION`` standard deviations. A path occurs in at least
    ``MIN_SHARE`` of the toxic texts, so the number of paths depends on the length of texts,
    not on how many there are.
    """

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, side in zip(batch["text"], batch["side"], strict=True):
                for p in {p for w in set(_PIECES.findall((text or "").lower())) for p in lexicon_paths(w)}:
                    seen.setdefault(p, [0, 0, 0, 0])[side] += 1
            yield pd.DataFrame([(p, *n) for p, n in seen.items()], columns=["path", *_SIDES])

    distinct = train.withColumn("_h", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["_h", "y"])
    sided = distinct.select("text", (2 * F.col("fold") + (F.col("y") == 1).cast("int")).alias("side"))  # neg0, pos0, neg1, pos1
    sizes = {r.side: r["count"] for r in sided.groupBy("side").count().collect()}
    counts = sided.mapInPandas(paths, "path string, " + ", ".join(f"{c} long" for c in _SIDES)).groupBy("path").agg(*[F.sum(c).alias(c) for c in _SIDES])
    counts = materialize(counts.filter(F.col("pos0") + F.col("pos1") >= 2), "toxic-paths")
    # A stem must stand for several words: it is more frequent than any one word behind it.
    words = counts.filter(~F.col("path").endswith("*")).withColumn("all", F.col("pos0") + F.col("pos1"))
    stems = F.explode(F.transform(F.filter(F.array(*map(F.lit, STEMS)), lambda n: F.length("path") > n), lambda n: F.concat(F.substr("path", F.lit(1), n), F.lit("*"))))
    top = words.select(stems.alias("path"), "all").groupBy("path").agg(F.max("all").alias("top"))
    counts = counts.join(top, "path", "left").filter(~F.col("path").endswith("*") | (F.col("pos0") + F.col("pos1") >= STEM_SPREAD * F.coalesce("top", F.lit(0))))
    out = []
    for folds in ((0,), (1,), (0, 1)):
        toxic, clean = sum(sizes.get(2 * f + 1, 0) for f in folds), sum(sizes.get(2 * f, 0) for f in folds)
        if not toxic or not clean:
            out.append({})
            continue
        pos, neg = (sum(F.col(f"{k}{f}") for f in folds) for k in ("pos", "neg"))
        low, high = pos - CAUTION * F.sqrt(pos), neg + CAUTION * F.sqrt(neg + 1)
        weight = F.log((low + 0.5) / (toxic + 1)) - F.log((high + 0.5) / (clean + 1))
        kept = counts.filter(pos >= max(MIN_TEXTS, math.ceil(MIN_SHARE * toxic))).withColumn("w", weight).filter(F.col("w") >= MIN_WEIGHT)
        out.append({r.path: r.w for r in kept.select("path", "w").orderBy("path").collect()})
    return out


_SIDES = ["neg0", "pos0", "neg1", "pos1"]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton steps on the penalised likelihood; the penalty pulls to ``prior``."""
    w = prior.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", allowed=None, sample: int = SAMPLE) -> Scorer | None:
    """Lexicon and model from labelled rows; None without both kinds of labels. The model is
    fitted on features from the lexicon of the other half, so it does not trust paths more
    than they hold on texts they were not learnt from."""
    train = labelled_sample(docs, labels, id_col, text_col, label_col, allowed or (lambda c: F.lit(True)), sample)
    train = train.withColumn("fold", F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("fold")), F.lit(2)).cast("int"))  # copies stay in one half
    *halves, lexicon = learn_lexicons(train)
    if not lexicon:
        return None
    scorers = [Scorer(half, PRIOR) for half in halves]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[float(y), *scorers[1 - fold].features(t)] for t, y, fold in zip(batch["text"], batch["y"], batch["fold"], strict=True)]
            yield pd.DataFrame({"row": rows}, columns=["row"])

    rows = train.select("text", (F.col("y") == 1).cast("int").alias("y"), "fold").mapInPandas(measure, "row array<double>")
    # Equal feature rows are counted, so the driver sees each different one once.
    counted = rows.select(F.transform("row", lambda v: F.round(v, 1)).alias("row")).groupBy("row").agg(F.count(F.lit(1)).alias("n")).collect()
    data = np.array(sorted([r.n, *r.row] for r in counted))  # one order, so that sums round alike
    repeat = np.repeat(data[:, 1:], data[:, 0].astype(int), axis=0)
    model = fit_logistic(repeat[:, 1:], repeat[:, 0], np.array(PRIOR))
    return Scorer(lexicon, tuple(model.tolist()))


def scored(docs: DataFrame, scorer: Scorer | None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with a score for each row."""
    others = [c for c in docs.columns if c != text_col]
    if scorer is None:
        return docs.select(*others, F.lit(0.0).alias("score"))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(scorer.lexicon, scorer.model)
        for texts in batches:
            yield texts.map(own.score, na_action=None).astype(float)

    return docs.select(*others, score(F.col(text_col)).alias("score"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """id, held_out, score, predicted. Rows with crc32(id) mod 4 = 2 are never learnt from."""
    scorer = fit(docs, labels, id_col, text_col, label_col, lambda c: doc_crc_mod(c, 4) != 2, sample)
    rows = scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scorer)
    return rows.select(
        F.col("id").alias(id_col), (doc_crc_mod("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` below the threshold, with their own columns."""
    scorer = fit(docs, labels, id_col, text_col, allowed=lambda c: doc_crc_mod(c, 4) != 2)
    if scorer is None:
        return docs

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(scorer.lexicon, scorer.model)
        for texts in batches:
            yield texts.map(own.score, na_action=None).astype(float)

    return docs.filter(score(F.col(text_col)) < threshold)
