"""Quality rules whose cutoffs carry a risk guarantee.

The signals of a text are built-in functions over arrays, row by row.  Their
cutoffs come from labelled documents: for each stratum and signal a fixed grid
of cutoffs is tried, and a cutoff may be used only if an exact binomial test
shows that it rejects at most a stated share of the good documents.  Down a
grid the tests are a fixed sequence: the loosest cutoff comes first and the
first failure ends it, so the whole grid costs the error of one test.  The
grids of all strata and signals share one budget (Bonferroni), so with the
stated confidence every cutoff in use keeps its promise at once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import BLANK_CLASS, BLANKS, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


@dataclass(frozen=True)
class Signal:
    """A ratio in which much is bad, the cutoffs that may be tried, and the
    part of the risk that it may use."""

    name: str
    value: str
    grid: tuple[float, ...]
    part: float


SIGNALS = (
    Signal("symbols", "n_symbols / n_words", (0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0), 0.4),
    Signal("dup_lines", "n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3, 0.5, 0.7), 0.1),
    Signal("repeats", "n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4), 0.1),
    Signal("long_words", "word_chars / n_words", (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0), 0.4),
)
#: Share of good documents that all signals together may reject, and the
#: chance that any cutoff breaks its part of that.  Signals that good texts
#: also show, such as a repeated passage, get the smaller parts.
RISK, DELTA = 0.01, 0.05
#: Terms of a binomial sum that are added one by one.
MAX_TERMS = 10_000
#: Strata beyond this many, the smallest ones, use the pooled cutoffs, so that
#: the table of cutoffs has a bound.  So do strata with too few labels.
MAX_STRATA = 256
#: Labelled ids up to which the rows they name are found by a broadcast join.
BROADCAST_LABELS = 1_000_000


def text_signals(docs: DataFrame, keep: Sequence[str] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are ``[^\\x20\\x09-\\x0D]+``.  Null text has none.  Everything is
    computed inside the row: no word ever leaves it, so no shuffle is needed
    and a very long text costs n log n.
    """
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        *[docs[c] for c in keep],
        F.array_remove(F.split(body, BLANK_CLASS + "+"), "").alias("words"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    words = F.col("words")
    rows = rows.select(
        "doc_id",
        *keep,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda word, i: F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)),
        ).alias("windows"),
    )
    values = [c for c in rows.columns if c != "windows"]
    # Sorting brings equal windows together; one that equals a neighbour occurs twice.
    rows = rows.select(
        *values,
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("sorted"),
    )
    cells = F.col("sorted")
    twice = F.filter(
        cells,
        lambda cell, j: F.coalesce(F.get(cells, j - 1)["h"] == cell["h"], F.lit(False))
        | F.coalesce(F.get(cells, j + 1)["h"] == cell["h"], F.lit(False)),
    )
    rows = rows.select(*values, F.array_sort(F.transform(twice, lambda cell: cell["i"])).alias("starts"))
    starts = F.col("starts")
    # A window covers three words, or as many as there are up to the next one.
    covered = F.aggregate(
        F.transform(starts, lambda at, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - at, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda total, words: total + words,
    )
    return rows.select(*values, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def value_of(signal: Signal) -> Column:
    """The signal's value; 0 for a text without words."""
    return F.when(F.col("n_words") > 0, F.expr(signal.value)).otherwise(F.lit(0.0))


def _log_sum(state: Column, step: Column) -> Column:
    """The next state: the term times e ** ``step``, and the sum with it, all in logarithms."""
    term = state["term"] + step
    high, low = F.greatest(term, state["sum"]), F.least(term, state["sum"])
    return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series; for n of 100 or more it is exact to 1e-15 and more."""
    x = (n + 1).cast("double")
    half = F.lit(0.5 * math.log(2 * math.pi))
    return (x - 0.5) * F.log(x) - x + half + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3.0)))


def binomial_below(k: Column, n: Column, p: float, max_terms: int = MAX_TERMS) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), summed in logarithms.

    Up to ``max_terms`` the sum is exact.  A longer one is summed downwards
    from k, and what is left out is replaced by the geometric series that
    bounds it: for k below n * p the result is never too small.
    """
    odds = math.log(p) - math.log1p(-p)
    first = n * F.lit(math.log1p(-p))
    steps = F.least(k, F.lit(max_terms).cast("long"))

    def up(state: Column, j: Column) -> Column:
        return _log_sum(state, F.log((n - j + 1) / j) + F.lit(odds))

    def down(state: Column, i: Column) -> Column:
        j = k - i + 1  # from the term of j to that of j - 1
        return _log_sum(state, F.log(j / (n - j + 1)) - F.lit(odds))

    def summed(start: Column, step) -> Column:
        state = F.struct(start.alias("term"), start.alias("sum"))
        return F.aggregate(F.sequence(F.lit(1).cast("long"), steps), state, step)

    at_k = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.lit(math.log(p)) + (n - k) * F.lit(math.log1p(-p))
    last = summed(at_k, down)
    ratio = (k - steps) / (n - k + steps + 1) * F.lit(math.exp(-odds))
    rest = last["term"] + F.log(ratio) - F.log(1 - ratio)
    beyond = F.when(ratio >= 1, F.lit(0.0)).otherwise(F.least(F.lit(0.0), last["sum"] + F.log1p(F.exp(rest - last["sum"]))))
    return F.when(k <= 0, first).when(k <= max_terms, summed(first, up)["sum"]).otherwise(beyond)


def choose_cutoffs(
    signals: DataFrame,
    labels: DataFrame,
    stratum: str,
    risk: float = RISK,
    delta: float = DELTA,
    rules: Sequence[Signal] = SIGNALS,
) -> DataFrame:
    """One row per stratum: (stratum, pooled, n_good, and a cutoff or null per
    signal); the last one, with ``pooled`` true, is over all labelled strata.

    ``labels`` has doc_id and quality.  Good are the documents whose labels all
    say 1 and that pass the base rules.  Each signal may reject its part of
    ``risk`` of a stratum's good documents; a cutoff passes only if that many
    rejections or fewer would have a probability of at most ``delta`` / number
    of grids, were its true share larger.  From the loosest cutoff on, the last
    one before the first failure is used.  The pool is tested as one more
    stratum.  A stratum with too few labels for any cutoff of a signal gets the
    pooled one, unless that rejects more than the part (rounded up) of its own
    good documents.  A null rejects nothing.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = signals.filter(~base_failed()).join(good.filter("quality = 1"), "doc_id")
    tried = [(s, c) for s in rules for c in s.grid]
    counts = [f"k{i}" for i in range(len(tried))]
    counted = stored(
        rows.groupBy(F.col(stratum).alias("stratum")).agg(
            F.count("*").alias("n"), *[F.count_if(value_of(s) > c).alias(k) for k, (s, c) in zip(counts, tried, strict=True)]
        )
    )
    own = stored(counted.orderBy(F.desc("n"), "stratum").limit(MAX_STRATA))
    budget = math.log(delta / (len(rules) * (own.count() + 1)))

    def lowest(table: DataFrame) -> DataFrame:
        # Down a grid rejections only grow, and the bound with them: all before the lowest that passes pass too.
        allowed = []
        for k, (rule, cutoff) in zip(counts, tried, strict=True):
            share = risk * rule.part
            holds = (F.col(k) <= F.col("n") * share) & (binomial_below(F.col(k), F.col("n"), share) <= F.lit(budget))
            allowed.append(F.when(holds, F.lit(cutoff)))
        return table.select(
            "*",
            *[
                F.array_min(
                    F.array_compact(F.array(*[a for a, (s, _) in zip(allowed, tried, strict=True) if s is rule]))
                ).alias(f"cutoff_{rule.name}")
                for rule in rules
            ],
        )

    total = counted.agg(*[F.sum(c).alias(c) for c in ("n", *counts)]).filter("n > 0")
    pool = stored(lowest(total))
    pooled = pool.first()
    filled = []
    for rule in rules:
        found = F.col(f"cutoff_{rule.name}")
        cutoff = pooled[f"cutoff_{rule.name}"] if pooled else None
        if cutoff is not None:
            share = risk * rule.part
            few = F.col("n") * math.log1p(-share) > budget
            rejected = F.col(counts[tried.index((rule, cutoff))])
            found = F.coalesce(found, F.when(few & (rejected <= F.ceil(F.col("n") * share)), F.lit(cutoff)))
        filled.append(found.alias(f"cutoff_{rule.name}"))
    strata = lowest(own).select("stratum", F.lit(False).alias("pooled"), F.col("n").alias("n_good"), *filled)
    last = pool.select(
        F.lit(None).cast(own.schema["stratum"].dataType).alias("stratum"),
        F.lit(True).alias("pooled"),
        F.col("n").alias("n_good"),
        *[f"cutoff_{rule.name}" for rule in rules],
    )
    return stored(strata.unionByName(last).coalesce(1))


def with_verdict(
    signals: DataFrame, cutoffs: DataFrame, stratum: str, rules: Sequence[Signal] = SIGNALS
) -> DataFrame:
    """Add base_failed and kept.  There are at most ``MAX_STRATA`` cutoff rows,
    so that they are safe to broadcast, and the pooled one for all other strata."""
    pooled = cutoffs.filter("pooled").first()
    own = F.broadcast(cutoffs.filter("not pooled"))
    joined = signals.join(own, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    # A sum, so that a filter on it stays above the join: split into its parts,
    # it would be pushed down and have the signals computed once for each.
    faults = base_failed().cast("int")
    for rule in rules:
        name = f"cutoff_{rule.name}"
        other = F.lit(pooled[name] if pooled else None).cast("double")
        cutoff = F.when(F.col("n_good").isNull(), other).otherwise(F.col(name))
        faults = faults + F.coalesce(value_of(rule) > cutoff, F.lit(False)).cast("int")
    return (
        joined.withColumn("base_failed", base_failed()).withColumn("kept", faults == 0).drop(*cutoffs.columns)
    )


def judge_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed and kept for every row of ``docs`` (doc_id, text, lang).

    Strata are the values of lang, null being one.  Null text counts as empty
    and fails.  Repeated rows are judged alike, an empty table gives none, and
    without labels only the base rules reject.  Strata without cutoffs of their
    own are judged by the pooled ones.
    """
    own = docs.select(docs["doc_id"], docs["text"], docs["lang"].alias("_stratum"))
    signals = stored(text_signals(own, keep=["_stratum"]))
    cutoffs = choose_cutoffs(signals, labels, "_stratum", risk, delta)
    return with_verdict(signals, cutoffs, "_stratum").drop("_stratum", "n_lines")


def kept_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep.

    The cutoffs come from the labelled rows alone; the signals of all rows are
    then computed where the rows are read, so no text is shuffled or stored.

    Null and empty texts fail the base rules and go; very long ones are judged
    whole.  Rows with a null doc_id are judged by their text like all others,
    but no label is theirs.  Repeated rows stay or go together, an empty table
    stays empty, and other columns, whatever their names, pass unchanged.
    """
    known = labels.filter("doc_id is not null").select(F.col("doc_id").alias("_labelled")).distinct()
    own = docs.select(docs["doc_id"], docs["text"], docs["lang"].alias("_stratum"))
    few = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    labelled = own.join(F.broadcast(known) if few else known, F.col("doc_id") == F.col("_labelled"), "left_semi")
    signals = stored(text_signals(labelled, keep=["_stratum"]))
    cutoffs = choose_cutoffs(signals, labels, "_stratum", risk, delta)
    # All columns travel as one, so that none can clash with a signal's name.
    rows = docs.select(
        docs["doc_id"], docs["text"], docs["lang"].alias("_stratum"), F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    )
    judged = with_verdict(text_signals(rows, keep=["_stratum", "_row"]), cutoffs, "_stratum")
    return judged.filter("kept").select("_row.*")
