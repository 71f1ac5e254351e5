"""Quality rules combined by weak supervision (native).

Every rule votes good, bad or abstains. Expectation-maximisation over the
counts of vote patterns (at most 3 ** rules rows, whatever the corpus)
estimates the share of good documents and, for either class, how often each
rule votes each way. The posterior probability that a document is good is then
a sum of learned log-odds, evaluated as a plain column expression.

Defined cases: null or empty text has no words and fails the base rule;
repeated rows count each; an empty table gives no rows and keeps the starting
parameters; a null id stays null; other columns pass through ``score``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import Scratch, words

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_stops", "n_bangs", "n_pipes")
GOOD, BAD, ABSTAIN = 1, -1, 0


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts of BASE and EXTRA, as longs.

    A 3-word window that occurs again is found by sorting (hash, position)
    keys inside the row; neighbours with equal hashes are compared as words.
    Columns of that name in the input are replaced.
    """
    keep = [c for c in docs.columns if c not in BASE + EXTRA]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w = docs.select(*[F.col(f"`{c}`") for c in keep], words(body).alias("__w"))
    n = F.size("__w")
    m = F.greatest(n - 2, F.lit(0))
    # bits for a position; the rest of the key is the window's hash
    bits = F.length(F.bin(n.cast("long"))).cast("int")
    a, b, c = (F.slice("__w", F.lit(k), m) for k in (1, 2, 3))
    hashes = F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), c, lambda p, z: F.xxhash64(p.x, p.y, z))
    w = w.select("*", bits.alias("__b"), hashes.alias("__h"))
    keys = F.transform("__h", lambda h, i: F.call_function("shiftleft", h, F.col("__b")).bitwiseOR(i.cast("long")))
    w = w.select(*[x for x in w.columns if x != "__h"], F.sort_array(keys).alias("__k"))
    shifted = F.slice("__k", F.lit(2), F.greatest(F.size("__k") - 1, F.lit(0)))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__b")) - 1

    def at(key: Column) -> Column:
        return key.bitwiseAND(mask).cast("int")

    def same(x: Column, y: Column) -> Column:
        equal = F.call_function("shiftrightunsigned", x, F.col("__b")) == F.call_function("shiftrightunsigned", y, F.col("__b"))
        return F.when(equal, F.slice("__w", at(x) + 1, F.lit(3)) == F.slice("__w", at(y) + 1, F.lit(3))).otherwise(False)

    pairs = F.zip_with(
        F.slice("__k", F.lit(1), F.greatest(F.size("__k") - 1, F.lit(0))),
        shifted,
        lambda x, y: F.when(same(x, y), F.array(at(x), at(y))),
    )
    hits = F.array_sort(F.array_distinct(F.flatten(F.array_compact(pairs))))
    w = w.select(*[x for x in w.columns if x not in ("__k", "__b")], hits.alias("__hits"))
    last = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "__hits",
        last,
        lambda s, p: F.struct(p.alias("at"), (s.n + F.least(F.lit(3), p - s.at)).alias("n")),
    ).n
    lines = F.filter(F.split(body, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    w = w.select("*", lines.alias("__lines"))

    def count(chars: str) -> Column:
        return (F.length(body) - F.length(F.replace(body, F.lit(chars), F.lit("")))).cast("long")

    return w.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        count(".").alias("n_stops"),
        count("!").alias("n_bangs"),
        count("|").alias("n_pipes"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``features``."""
    n, lines = F.col("n_words"), F.col("n_lines")
    sym, rep, dup = F.col("n_symbols"), F.col("n_repeat_words"), F.col("n_dup_lines")
    chars, upper = F.col("word_chars"), F.col("n_upper")
    return {
        "symbols": _vote(50 * sym <= n, 4 * sym >= n),
        "repeats": _vote(5 * rep <= n, 2 * rep > n),
        "dup_lines": _vote((dup == 0) & (lines > 1), (2 * dup > lines) & (lines > 3)),
        "word_length": _vote((chars >= 3 * n) & (chars <= 9 * n), (chars < 2 * n) | (chars > 14 * n)),
        "upper": _vote(10 * upper <= chars, 2 * upper > chars),
        "sentences": _vote((60 * F.col("n_stops") >= n) & (2 * F.col("n_stops") <= n), F.col("n_stops") * 400 < n),
        "bangs": _vote(100 * F.col("n_bangs") <= n, 3 * F.col("n_bangs") >= n),
        "pipes": _vote(F.col("n_pipes") == 0, 10 * F.col("n_pipes") >= n),
    }


@dataclass
class VoteModel:
    """Share of good documents, and P(vote | class) of each rule."""

    rules: list[str]
    prior: float = 0.8
    table: dict = field(default_factory=dict)
    #: A rule speaks against a good document at most this often. Without the
    #: bound the likelihood may join one kind of bad document to the good class.
    false_alarm: float = 0.005

    def __post_init__(self):
        if not self.table:
            # rules rarely speak against a good document; a bad one breaks one or two
            good = {GOOD: 0.7, ABSTAIN: 0.295, BAD: 0.005}
            bad = {GOOD: 0.6, ABSTAIN: 0.25, BAD: 0.15}
            self.table = {r: {True: dict(good), False: dict(bad)} for r in self.rules}

    def fit(self, patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> VoteModel:
        """EM over (votes, count); a smoothing count of one keeps shares above zero."""
        patterns = sorted(patterns)
        total = sum(c for _, c in patterns)
        if not total:
            return self
        for _ in range(rounds):
            sums = {r: {y: dict.fromkeys((GOOD, ABSTAIN, BAD), 1.0) for y in (True, False)} for r in self.rules}
            good = 0.0
            for v, c in patterns:
                p = self.posterior(v)
                good += c * p
                for r, x in zip(self.rules, v, strict=True):
                    sums[r][True][x] += c * p
                    sums[r][False][x] += c * (1 - p)
            prior = (good + 1) / (total + 2)
            moved = abs(prior - self.prior)
            for of in sums.values():
                rest = of[True][GOOD] + of[True][ABSTAIN]
                of[True][BAD] = min(of[True][BAD], rest * self.false_alarm / (1 - self.false_alarm))
            self.prior = prior
            self.table = {
                r: {y: {x: s / sum(by.values()) for x, s in by.items()} for y, by in of.items()} for r, of in sums.items()
            }
            if moved < 1e-9:
                break
        return self

    def weight(self, rule: str, vote: int) -> float:
        t = self.table[rule]
        return math.log(t[True][vote] / t[False][vote])

    def posterior(self, v: tuple[int, ...]) -> float:
        x = math.log(self.prior / (1 - self.prior)) + sum(self.weight(r, k) for r, k in zip(self.rules, v, strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))

    def column(self, by_rule: dict[str, Column]) -> Column:
        """The posterior as an expression over vote columns."""
        x = F.lit(math.log(self.prior / (1 - self.prior)))
        for r, v in by_rule.items():
            x = x + F.when(v == GOOD, self.weight(r, GOOD)).when(v == BAD, self.weight(r, BAD)).otherwise(self.weight(r, ABSTAIN))
        return 1 / (1 + F.exp(-x))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_votes(counted: DataFrame) -> VoteModel:
    """Fit on the vote patterns of all rows that the base rules leave to the votes."""
    rules = votes()
    rows = counted.where(~base_failed()).groupBy(*[v.alias(r) for r, v in rules.items()]).count().collect()  # at most 3 ** rules rows
    return VoteModel(list(rules)).fit([(tuple(r[x] for x in rules), r["count"]) for r in rows])


def judged(counted: DataFrame, model: VoteModel) -> DataFrame:
    """``counted`` with base_failed, quality (posterior) and kept."""
    p = model.column(votes())
    return counted.withColumns({"base_failed": base_failed(), "quality": p, "kept": ~base_failed() & (p >= 0.5)})


def score(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id, counts, posterior and verdict.

    The counts are written once to the shared folder; texts are read once.
    """
    counted = features(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))).drop("text")
    counted = Scratch(docs.sparkSession, "quality").save(counted, "counts")
    return judged(counted, fit_votes(counted))


def keep_good(docs: DataFrame, *, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with its columns.

    Rows and their counts are written once to the shared folder, as one column
    beside the counts, so that nothing is counted twice, rows need no key and no
    column of theirs can clash.
    """
    tagged = docs.select(F.struct("*").alias("row"), F.col(f"`{text_column}`").alias("text"))
    counted = Scratch(docs.sparkSession, "quality").save(features(tagged).drop("text"), "counted")
    kept = judged(counted, fit_votes(counted)).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
