"""Problem 8: statistics of text quality as native expressions, and an ordered rule list learned from readers' verdicts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrinium.durable import durable
from scrinium.sampling import bounded_sample

#: The rules are learned from at most so many labelled rows (a uniform sample by hash).
LABELLED = 50_000
#: Lines under so many characters are short.
SHORT = 40
#: Thresholds that are tried for each figure.
STEPS = 256

_LISTED = r"(?m)^(?:\t|[ ]*+(?:[-•*·▪◦‣–—→►]\s|\(?(?:\p{L}|\d{1,3}|[ivxIVX]{1,4})[.)]\s|\d+(?:\.\d+)+\.?\s)).*+(?<![.!?…])$"
_COLUMNS = r'(?m)^(?:.*?(?=[|\t;" <.=,])(?:[|\t]|;(?=\S)|","| {3,}|</?\w+>|\.{4,}|=(?=\S)|,(?=[^\s\d]))){2}.*+$'

FIGURES = ["parole", "lunghezza_media", "quota_simboli", "quota_cifre", "quota_lettere", "quota_righe_punto", "quota_comuni", "frasi", "quota_elenco", "quota_tabella", "quota_corta", "quota_corrente", "lettere_correnti"]


def _trie(words: list[str]) -> str:
    """A regular expression of exactly ``words`` that shares their beginnings."""
    tree: dict = {}
    for w in words:
        at = tree
        for c in w:
            at = at.setdefault(c, {})
        at[""] = {}

    def write(at: dict) -> str:
        branches = [re.escape(c) + write(x) for c, x in sorted(at.items()) if c]
        if not branches:
            return ""
        return "(?:" + "|".join(branches) + ")" + ("?" if "" in at else "")

    return write(tree)


def statistics(df: DataFrame, common: list[str], text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the figures of each text; all of it native, in one pass, without a shuffle.

    ``parole`` words; ``lunghezza_media`` letters in a word; ``quota_simboli``, ``quota_cifre``, ``quota_lettere``
    shares of the characters; ``quota_righe_punto`` share of the lines with text that end a sentence;
    ``quota_comuni`` share of the words that are in ``common``; ``frasi`` sentence ends, in
    lines of none of the following kinds, for 100 words; ``quota_elenco``, ``quota_tabella``, ``quota_corta`` shares of the characters in lines that are list items, have
    columns, or else are short and don't end a sentence (list items that end one are no list); ``quota_corrente`` share of what is left, ``lettere_correnti`` of its letters.
    Null text: all figures null; a text without words or lines: 0 for shares of these.  Repeated rows stay
    repeated, other columns are kept; one that has the name of a figure is replaced.
    """
    kept = [c for c in df.columns if c != text and c not in FIGURES]
    size = lambda c: F.length(c).cast("double")
    without = lambda c, pattern: F.regexp_replace(c, pattern, "")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    t = F.col("_t")
    known = sorted({w.lower() for w in common if w})
    steps = df.select(*kept, F.col(text).alias("_t")).select("*", without(t, _LISTED).alias("_1"))
    steps = steps.select("*", without(F.col("_1"), _COLUMNS).alias("_2")).select("*", without(F.col("_2"), r"(?m)^.{1,%d}+(?<![.!?…])$" % (SHORT - 1)).alias("_3"))
    counted = steps.select(
        *kept,
        size(t).alias("n"),
        size("_1").alias("n1"),
        size("_2").alias("n2"),
        size("_3").alias("n3"),
        size(without(t, r"[^\p{L}\p{M}]+")).alias("letters"),
        size(without(F.col("_3"), r"[^\p{L}\p{M}]+")).alias("running"),
        size(without(t, r"[^\p{N}]+")).alias("digits"),
        size(without(t, r"[^\s]+")).alias("spaces"),
        count(t, r"[\p{L}\p{M}]++").alias("words"),
        count(t, r"(?m)^[^\S\r\n]*+\S").alias("lines"),
        count(t, r"(?m)[.!?…][\"'»)\]]?[^\S\r\n]*+$").alias("ended"),
        count(F.col("_3"), r"[.!?…](?=[\s\"'»)]|\z)").alias("sentences"),
        (count(F.lower(t), r"(?<![\p{L}\p{M}])" + _trie(known) + r"(?![\p{L}\p{M}])") if known else F.lit(0.0)).alias("known"),
    )
    share = lambda a, b: F.when(F.col("n").isNull(), F.lit(None).cast("double")).when(b > 0, a / b).otherwise(0.0)
    c = F.col
    # removing lines leaves their ends, so that shares are of the characters removed
    return counted.select(
        *kept,
        c("words").alias("parole"),
        share(c("letters"), c("words")).alias("lunghezza_media"),
        share(c("n") - c("letters") - c("digits") - c("spaces"), c("n")).alias("quota_simboli"),
        share(c("digits"), c("n")).alias("quota_cifre"),
        share(c("letters"), c("n")).alias("quota_lettere"),
        share(c("ended"), c("lines")).alias("quota_righe_punto"),
        share(c("known"), c("words")).alias("quota_comuni"),
        share(100 * c("sentences"), c("words")).alias("frasi"),
        share(c("n") - c("n1"), c("n")).alias("quota_elenco"),
        share(c("n1") - c("n2"), c("n")).alias("quota_tabella"),
        share(c("n2") - c("n3"), c("n")).alias("quota_corta"),
        share(c("n3"), c("n")).alias("quota_corrente"),
        share(c("running"), c("n")).alias("lettere_correnti"),
    )


@dataclass(frozen=True)
class Test:
    """``figure <= value`` or ``figure > value``."""

    figure: int
    below: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.figure] <= self.value if self.below else x[:, self.figure] > self.value

    def sql(self, names: list[str]) -> str:
        return f"{names[self.figure]} {'<=' if self.below else '>'} {self.value!r}D"


Rule = list[Test]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def grow(x: np.ndarray, y: np.ndarray) -> Rule:
    """Add the test of most information gain (FOIL) until no negative row is covered or nothing helps."""
    rule: Rule = []
    while True:
        pos, neg = int(y.sum()), int((~y).sum())
        if not neg or not pos:
            return rule
        before = np.log2(pos / (pos + neg))
        best, found = 1e-9, None
        for f in range(x.shape[1]):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, STEPS + 1), method="midpoint"))
            at = np.searchsorted(cuts, x[:, f])
            p = np.cumsum(np.bincount(at[y], minlength=len(cuts))[: len(cuts)])
            n = np.cumsum(np.bincount(at[~y], minlength=len(cuts))[: len(cuts)])
            for below, pp, nn in ((True, p, n), (False, pos - p, neg - n)):
                with np.errstate(all="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], Test(f, below, float(cuts[k]))
        if found is None or found in rule:
            return rule
        rule.append(found)
        inside = found.holds(x)
        x, y = x[inside], y[inside]


def prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    """Drop last tests while (right - wrong) / covered on the pruning rows does not fall."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        return (int(y[c].sum()) - int((~y[c]).sum())) / c.sum() if c.any() else -1

    best = max(range(1, len(rule) + 1), key=lambda k: (worth(rule[:k]), -k))
    return rule[:best]


def learn(x: np.ndarray, y: np.ndarray, seed: int = 5) -> list[Rule]:
    """Ordered rules for ``y`` by incremental reduced-error pruning: grow on two thirds, prune on one, until a rule is more
    often wrong than right; then rules that don't lower the error over all rows are dropped."""
    rng, left, rules = np.random.default_rng(seed), np.ones(len(x), bool), []
    whole_x, whole_y = x, y
    while left.any() and y[left].any():
        rows = np.flatnonzero(left)
        part = rng.random(len(rows)) < 2 / 3
        for side in (True, False):  # both parts of each kind, where there are rows enough
            if not y[rows[part == side]].any():
                part[rng.choice(np.flatnonzero(y[rows]), 1)] = side
        rule = grow(x[rows[part]], y[rows[part]])
        if not rule:
            break
        rest = rows[~part]
        rule = prune(rule, x[rest], y[rest])
        c = covers(rule, x[rest])
        if not c.any() or y[rest][c].mean() <= 0.5:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return _shortened(rules, whole_x, whole_y)


def _shortened(rules: list[Rule], x: np.ndarray, y: np.ndarray) -> list[Rule]:
    wrong = lambda rs: int((predict(rs, x) != y).sum()) + len(rs)
    while rules:
        k = min(range(len(rules)), key=lambda i: wrong(rules[:i] + rules[i + 1 :]))
        if wrong(rules[:k] + rules[k + 1 :]) > wrong(rules):
            return rules
        rules = rules[:k] + rules[k + 1 :]
    return rules


def predict(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for rule in rules:
        out |= covers(rule, x)
    return out


def case_sql(rules: list[Rule], names: list[str] = FIGURES) -> str:
    """The rule list as SQL: the number of the first rule that holds, 0 if none does."""
    whens = " ".join(f"WHEN {' AND '.join(t.sql(names) for t in rule)} THEN {k}" for k, rule in enumerate(rules, 1))
    return f"CASE {whens} ELSE 0 END" if rules else "0"


def labelled_rows(figures: DataFrame, labels: DataFrame, key: str = "doc_id", bound: int = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Figures of labelled rows and whether they are not prose, by their readers' majority; undecided ones are left out."""
    verdict = labels.groupBy(key).agg(F.avg("prosa").alias("v")).filter("v <> 0.5")
    judged = figures.join(verdict, key).dropDuplicates([key]).filter("parole IS NOT NULL")
    rows = bounded_sample(judged, key, bound, labels.count()).select(*FIGURES, "v").toPandas()
    return rows[FIGURES].to_numpy(float), rows["v"].to_numpy(float) < 0.5


def quality(documents: DataFrame, labels: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, figures, regola, prosa): every text's figures, the rule that rejects it (0: none) and 1 where it is prose.

    The figures of all texts are computed once; the rules are learned from the labelled ones and go back to Spark as a
    CASE expression.  Null, empty and blank texts: prosa is null, and regola 0.  Without labels no rule is learned.
    ``common`` is a word list (parola); it becomes part of an expression.
    """
    words = [r[0] for r in common.select("parola").distinct().limit(20_001).collect()]
    if len(words) > 20_000:
        raise ValueError("the list of common words is too long for an expression")
    blank = ~F.coalesce(F.col(text).rlike(r"\S"), F.lit(False))
    figures = durable(statistics(documents.select(key, F.col(text), blank.alias("vuoto")), words, text))
    rules = learn(*labelled_rows(figures.filter("NOT vuoto"), labels, key))
    rule: Column = F.when(F.col("vuoto"), 0).otherwise(F.expr(case_sql(rules)))
    return figures.select(key, *FIGURES, "vuoto", rule.cast("int").alias("regola")).select(key, *FIGURES, "regola", F.when(~F.col("vuoto"), (F.col("regola") == 0).cast("int")).alias("prosa"))


def not_prose(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key) of texts that a rule rejects."""
    return judged.filter("prosa = 0").select(key).distinct()
