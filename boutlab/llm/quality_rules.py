"""Quality rules as weak supervision: they vote or abstain instead of having to pass all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import SPACE, SPACES, unpacked
from boutlab.llm.label_model import fit_label_model
from boutlab.sources.tables import stage

SYMBOLS = "#*$%&|<>"
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
# Share of good documents before any rule has voted.
PRIOR = 0.85


def with_signals(docs: DataFrame) -> DataFrame:
    """Add the counts that the rules look at to rows with a column ``_text``, each inside its row.

    ``n_repeat_words`` counts words in 3-word windows that occur at least twice in the text: windows
    are compared by a 64-bit hash, sorted only where one repeats, and the words they cover are
    summed along their positions.
    """
    text = F.coalesce("_text", F.lit(""))
    cut = (
        docs.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != ""))
        .withColumn(
            "_lines",
            F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        )
        .withColumn("_solid", F.translate(text, SPACES, ""))
        .withColumn("_n", F.size("_words").cast("long"))
    )
    windows = F.expr(
        "if(_n < 3, cast(array() AS array<bigint>), transform(sequence(0, int(_n) - 3), "
        "i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"
    )
    # Whether any window repeats is a hash set; only texts where one does are sorted.
    placed = F.expr(
        "if(size(array_distinct(_windows)) = size(_windows), "
        "cast(array() AS array<struct<h: bigint, i: int>>), "
        "sort_array(transform(_windows, (h, i) -> struct(h, i))))"
    )
    again = F.expr(
        "sort_array(transform(filter(_placed, (x, i) -> "
        "(i > 0 AND get(_placed, i - 1).h = x.h) OR coalesce(get(_placed, i + 1).h = x.h, false)), "
        "x -> x.i))"
    )
    covered = F.expr(
        "aggregate(_again, struct(-3 AS at, 0L AS n), "
        "(a, p) -> struct(p AS at, a.n + least(3, p - a.at) AS n), a -> a.n)"
    )
    counted = cut.withColumn("_windows", windows).withColumn("_placed", placed).withColumn("_again", again)

    def count(pattern: str) -> Column:
        return F.regexp_count("_solid", F.lit(pattern))

    return counted.select(
        *docs.columns,
        F.col("_n").alias("n_words"),
        F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_solid") - F.length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
        count("[A-Z]").alias("_capitals"),
        count("[a-z]").alias("_small"),
        count("[.?]").alias("_stops"),
        count("!").alias("_exclaiming"),
    ).withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))


def rules() -> dict[str, Column]:
    """Each rule votes 1 for good, -1 for bad, or 0: it cannot tell."""
    bad = {
        "vote_length": "n_words < 50",
        "vote_word_size": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
        "vote_symbols": "8 * n_symbols > n_words",
        "vote_repeats": "5 * n_repeat_words > 2 * n_words",
        "vote_lines": "3 * n_dup_lines > _n_lines",
        "vote_capitals": "_capitals > _small",
        "vote_exclaiming": "5 * _exclaiming > n_words",
        "vote_sentences": "n_words >= 100 AND 200 * _stops < n_words",
    }
    # Speaks up for running text; the others only speak against.
    prose = (
        "n_words >= 100 AND 60 * _stops >= n_words AND 8 * _capitals < _small "
        "AND 40 * n_symbols < n_words AND 10 * n_repeat_words < n_words"
    )
    return {name: F.when(F.expr(when), -1).otherwise(0) for name, when in bad.items()} | {
        "vote_prose": F.when(F.expr(prose), 1).otherwise(0)
    }


def judge_quality(
    docs: DataFrame, prior: float = PRIOR, passed_on: Sequence[str] | None = None
) -> DataFrame:
    """Add the signals, ``posterior`` and ``kept`` to every document.

    Rules vote, expectation-maximisation over the counts of vote patterns of the whole table
    estimates how accurate each is, and the posterior probability of good quality decides:
    ``kept`` is true from 0.5, unless the base rules (``base_failed``) reject the text.

    Votes and the columns ``passed_on`` (all, if None) are written to the shared folder once, as the
    model needs all votes before the first document can be judged. Nothing is shuffled but pattern
    counts.

    A null text counts as an empty one, which fails; repeated rows are judged alike; an empty table
    stays empty; other columns are passed on, but one named like a result is replaced.
    """
    names = list(passed_on if passed_on is not None else docs.columns)
    rows = docs.select(F.struct(*names).alias("_row"), F.col("text").alias("_text"))
    signals = with_signals(rows).drop("_text")
    voted = stage(signals.withColumns(rules()), "quality_votes")
    model = fit_label_model(voted, list(rules()), prior)
    posterior = model.posterior()
    judged = voted.withColumn("posterior", posterior).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)
    )
    return unpacked(judged, names, [*SIGNALS, "posterior", "kept"])


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents whose posterior says good, with their own columns."""
    judged = judge_quality(docs.select(F.struct("*").alias("_doc"), "text"), passed_on=["_doc"])
    return judged.filter("kept").select("_doc.*")
