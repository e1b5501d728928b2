"""Toxicity by a weighted finite-state grammar over clauses.

Words are read as symbols: insult, threat, target, negation, reporting verb, other. Small transducers each follow one
thing through a clause (a negation just passed, a target near by, reported speech, an open threat); their product
reads a clause once and puts out matches, such as an insult at a target that is not negated, with the insult's weight.
A document's score is a logistic function of its sums of matches. Insults (words and stems) and all weights are
learned from labelled documents. Some stems come in clean texts by chance: those are insults from the second word of a
text on that has them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import id_remainder, text_or_empty
from siltstone.sources.tables import written

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Fixed words of the grammar in the four languages of the corpus.
WORDS = {
    THREAT: "kill hurt destroy beat attack murder shoot töten verletzen zerstören schlagen tuer blesser détruire frapper matar herir destruir golpear",
    TARGET: "you your yours he him she her they them du dich dein ihr euch sie tu te toi vous ils elles tú ti usted ustedes él ella ellos",
    NEGATION: "not no never nobody nothing isn't aren't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say told wrote writes claimed claims called quoted reported sagte sagt schrieb behauptet nannte dit disait écrit affirme dijo dice escribió afirma llamó",
}
#: Words over which a negation, a target or a threat reaches.
REACH = 3
#: Labelled documents that the model is learned from at most, those with the least hashes of their ids.
LABELLED_ROWS = 20_000
#: Entries of the learned grammar at most.
MOST_ENTRIES = 5_000
STEMS = (3, 4, 5, 6)
#: Share of toxic documents among those with an entry, at least.
PRECISION = 0.8
PREDICT = 0.7
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


@dataclass(frozen=True)
class Transducer:
    """`step` takes a state and a symbol to the next state and what it says of a match at this word."""

    start: int
    step: dict[tuple[int, int], tuple[int, str]]


def reach(symbol: int, name: str) -> Transducer:
    """Says `name` for REACH words after `symbol`."""
    step = {(k, s): (REACH if s == symbol else max(0, k - 1), name if k else "") for k in range(REACH + 1) for s in range(6)}
    return Transducer(0, step)


def latch(symbol: int, name: str) -> Transducer:
    """Says `name` to the end of the clause, after `symbol`."""
    return Transducer(0, {(k, s): (int(k or s == symbol), name if k else "") for k in (0, 1) for s in range(6)})


def matcher(symbol: int, name: str) -> Transducer:
    """Says `name` at `symbol`."""
    return Transducer(0, {(0, s): (0, name if s == symbol else "") for s in range(6)})


def threatening() -> Transducer:
    """Says `threat` when a threat and a target come within REACH words of each other, in either order."""
    step = {}
    for k in range(REACH + 1):
        for toward in (THREAT, TARGET):
            for s in range(6):
                met = k > 0 and s in (THREAT, TARGET) and s != toward
                state = (REACH if s in (THREAT, TARGET) else max(0, k - 1)) * 2 + ((s == TARGET) if s in (THREAT, TARGET) else (toward == TARGET))
                step[(k * 2 + (toward == TARGET), s)] = (state, "threat" if met else "")
    return Transducer(0, step)


class Grammar:
    """The product of the transducers, made as its states are met."""

    def __init__(self):
        self.parts = (matcher(INSULT, "insult"), threatening(), reach(NEGATION, "negated"), reach(TARGET, "targeted"), latch(REPORT, "reported"))
        self.start = tuple(p.start for p in self.parts)
        self.step: dict[tuple[tuple, int], tuple[tuple, str]] = {}

    def next(self, state: tuple, symbol: int) -> tuple[tuple, str]:
        if (known := self.step.get((state, symbol))) is None:
            moves = [p.step[(s, symbol)] for p, s in zip(self.parts, state, strict=True)]
            says = [m[1] for m in moves if m[1]]
            kind = says[0] if says and says[0] in ("insult", "threat") else ""
            # a threat has met its target
            how = next((x for x in ("negated", "reported", "targeted") if x in says), "targeted" if kind == "threat" else "plain")
            known = self.step[(state, symbol)] = (tuple(m[0] for m in moves), f"{kind}:{how}" if kind else "")
        return known

    def matches(self, clause: list[tuple[int, float]]) -> Iterator[tuple[str, float]]:
        """(kind, weight) of what a clause of (symbol, weight) holds."""
        state = self.start
        for symbol, weight in clause:
            state, says = self.next(state, symbol)
            if says:
                yield says, weight


#: Matches by kind, and all of them to a hundred words.
FEATURES = ("density", "insult:plain", *(f"{kind}:{how}" for kind in ("insult", "threat") for how in ("targeted", "negated", "reported")))


@dataclass
class Model:
    """Weights of words and stems, and of the logistic function over FEATURES.

    Entries are words and stems; those in `repeated` count, the first match too, from their second match in a text on.
    """

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    repeated: frozenset[str] = frozenset()
    bias: float = -2.0
    weights: tuple[float, ...] = (2.0,) * len(FEATURES)

    def symbol(self, word: str) -> tuple[int, float, str]:
        """(symbol, weight, entry): the entry is empty but for those that need a second match."""
        for k, text in _FIXED.items():
            if word in text:
                return k, 1.0, ""
        if word in self.words:
            return INSULT, self.words[word], ""
        for n in STEMS:
            if (w := self.stems.get(word[:n])) is not None and len(word) >= n:
                return INSULT, w, word[:n] if word[:n] in self.repeated else ""
        return OTHER, 0.0, ""


_FIXED = {k: frozenset(v.split()) for k, v in WORDS.items()}


class Scorer:
    """Reads texts with a model; symbols of words are looked up, and kept for the words seen last."""

    def __init__(self, model: Model):
        self.model, self.grammar, self.symbols = model, Grammar(), {}

    def features(self, text: str) -> np.ndarray:
        """log(1 + sum of weights) of the matches of each kind, and of all to a hundred words.

        Only clauses that hold an insult or a threat are read by the grammar.
        """
        out, n_words = dict.fromkeys(FEATURES, 0.0), 0
        if len(self.symbols) > 300_000:
            self.symbols.clear()
        clause: list[tuple[int, float]] = []
        hot, met = False, Counter()
        for token in [*TOKEN.findall(text.lower()), "."]:
            if token in ENDS:
                if hot:
                    for kind, weight in self.grammar.matches(clause):
                        out[kind] += weight
                clause, hot = [], False
                continue
            if (s := self.symbols.get(token)) is None:
                s = self.symbols[token] = self.model.symbol(token)
            symbol, weight, entry = s
            n_words += 1
            if entry:
                met[entry] += 1
                if met[entry] == 1:
                    symbol, weight = OTHER, 0.0
                elif met[entry] == 2:
                    weight *= 2
            hot |= symbol in (INSULT, THREAT)
            clause.append((symbol, weight))
        out["density"] = 100 * sum(out.values()) / max(1, n_words)
        return np.log1p(np.array([out[k] for k in FEATURES]))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.model.bias + float(np.dot(self.features(text), self.model.weights))))))


def learn_lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], frozenset[str]]:
    """Words and stems that mark toxic documents, with log odds, and the stems that do so from their second match on.

    `sample` is a written table (text, toxic). Of documents that share their least window of three words, as copies do,
    one counts. Of the documents with an entry, or else of those that match it twice, PRECISION at least must be toxic,
    and the likelihood ratio must be beyond what chance gives among all entries seen. A stem stands for all words and
    longer stems that begin with it.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))
    tokens = F.split(F.lower("text"), r"\s+")
    size = F.size(tokens)
    first = F.array_min(F.transform(F.arrays_zip(tokens.alias("a"), F.slice(tokens, F.lit(2), F.greatest(size, F.lit(1))).alias("b"), F.slice(tokens, F.lit(3), F.greatest(size, F.lit(1))).alias("c")), lambda x: F.xxhash64(x["a"], x["b"], x["c"])))
    single = sample.select("toxic", words.alias("words"), first.alias("key")).groupBy("key", "toxic").agg(F.max("words").alias("words"))
    entries = F.array(F.concat(F.lit("="), F.col("w")), *[F.when(F.length("w") >= n, F.substr("w", F.lit(1), F.lit(n))) for n in STEMS])
    matches = single.withColumn("d", F.monotonically_increasing_id()).select("toxic", "d", F.explode("words").alias("w")).select("toxic", "d", F.explode(entries).alias("e")).where("e is not null")
    per_doc = matches.groupBy("toxic", "d", "e").agg((F.count(F.lit(1)) > 1).cast("int").alias("twice"))
    both = F.col("toxic") * F.col("twice")
    counts = written(per_doc.groupBy("e").agg(F.sum("toxic").alias("a1"), F.count(F.lit(1)).alias("a"), F.sum(both).alias("b1"), F.sum("twice").alias("b")), "entries")
    seen, (docs, toxic) = counts.count(), single.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == docs:
        return {}, {}, frozenset()
    base = toxic / docs
    # each entry is looked at in two ways
    cut = 2 * math.log(2 * seen / 0.01)

    def evidence(n1: Column, n: Column) -> Column:
        """The likelihood ratio of an entry whose documents are toxic often enough; null for others."""
        part = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
        ratio = 2 * (part(n1, base) + part(n - n1, 1 - base))
        return F.when((F.try_divide(n1, n) >= PRECISION) & (ratio >= cut), ratio)

    once, twice = evidence(F.col("a1"), F.col("a")), F.when(~F.startswith("e", F.lit("=")), evidence(F.col("b1"), F.col("b")))
    chosen = counts.withColumns({"ratio": F.coalesce(once, twice), "again": once.isNull()}).where("ratio is not null")
    odds = lambda n1, n: math.log((n1 + 0.5) / (toxic + 1)) - math.log((n - n1 + 0.5) / (docs - toxic + 1))
    rows = {r["e"]: (odds(*((r["b1"], r["b"]) if r["again"] else (r["a1"], r["a"]))), r["again"]) for r in chosen.orderBy(F.desc("ratio"), "e").limit(MOST_ENTRIES).collect()}
    stems: dict[str, float] = {}
    repeated: set[str] = set()
    # stems that count at once come before those that need a second match
    for e in sorted((e for e in rows if e[0] != "="), key=lambda e: (rows[e][1], len(e))):
        if not any(e[:n] in stems for n in STEMS if n <= len(e)):
            stems[e] = rows[e][0]
            if rows[e][1]:
                repeated.add(e)
    words_only = {e[1:]: w for e, (w, _) in rows.items() if e[0] == "=" and not any(e[1 : n + 1] in stems and e[1 : n + 1] not in repeated for n in STEMS)}
    return words_only, stems, frozenset(repeated)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> tuple[float, tuple[float, ...]]:
    """Logistic regression with a ridge, by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta, hold = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + hold, x.T @ (y - p) - hold @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), tuple(map(float, beta[1:]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> Model:
    """A model from `rows` labelled documents at most; of several labels of a document the highest counts.

    To the driver go the grammar's entries, MOST_ENTRIES at most, and FEATURES and label of each sampled document.
    Without toxic documents all scores are low.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(rows)
    sample = written(docs.join(F.broadcast(known), F.col(id_col) == F.col("__id")).select(text_or_empty(text_col).alias("text"), "toxic"), "labelled")
    words, stems, repeated = learn_lexicon(sample)
    model = Model(words, stems, repeated)
    if not words and not stems:
        return model

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        scorer = Scorer(model)
        return pd.Series([scorer.features(t) for t in texts])

    got = sample.select(features("text").alias("x"), "toxic").toPandas()
    model.bias, model.weights = fit(np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(np.float64))
    return model


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with `out`, 0 to 1. Null and empty texts score as texts without a match.

    Every row is judged alone, by the whole of its text; no rows: none; a column named `out` is replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(text_or_empty(text_col)))


def op5_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out)
    model = learn(docs.where("not held_out"), labels.where(~held_out))
    out = score_documents(docs, model)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= PREDICT, 1).otherwise(0).alias("predicted"))
