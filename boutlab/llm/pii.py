"""Personal data by weak supervision: labelers vote on candidate spans, with DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import carried, unpacked
from boutlab.llm.label_model import fit_label_model
from boutlab.sources.tables import stage

# Fixed patterns. Possessive loops never give back what no other reading could use, so a long run
# costs one pass; look-behind keeps a search from starting inside a run that has failed as a whole.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser forms that only the vote of the labelers turns into spans.
LOOSE = {
    "phone_national": r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "email_spelt": rf"(?<!{_LOCAL})[A-Za-z0-9._%+-]{{1,64}}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{{1,64}}"
    r"(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}){1,4}",
    "secret": r"(?i)\b(?:token|password|passwd|secret|api_?key)\x20{0,2}[=:]\x20{0,2}\x22?[0-9a-z_-]{16,256}+\x22?",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20\p{Lu}\p{L}{1,30}(?:\x20\p{Lu}\p{L}{1,30})?",
}
KINDS = (*BASE, *LOOSE)

# Gazetteers.
TOP_DOMAINS = "com net org edu gov io info biz eu uk us de fr es it nl ch at be se no pl pt ca au jp cn in br ru"
CUES = (
    "mail contact call phone telephone tel fax mobile reach card credit visa payment iban account ssn "
    "social ip address host login user token password key secret kontakt telefon correo llamar appeler"
)
ANTI_CUES = "version release isbn issn page pages order invoice figure fig table section article total price no nr"
COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK"

VOTES = ("v_shape", "v_checksum", "v_cue", "v_gazetteer", "v_bounds", "v_variety")
FEATURES = (*VOTES, "f_long", "f_separated", "f_opens_line", "f_letters")
_CONTEXT = 32


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits, of at most 19, has the check sum of card numbers."""
    turned = F.reverse(digits)
    each = F.transform(
        F.sequence(F.lit(1), F.length(turned)), lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    )
    summed = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return summed % 10 == 0


def _is_base(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(value, r"\.")
        return F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    count = F.length(_digits(value))
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return count.between(9, 15)


def _found(text: Column, kind: str, pattern: str) -> Column:
    """Matches of a pattern as (start, stop, kind, value, before, after), in code points.

    Spark tells no positions, but texts between matches and matches add up to them.
    """
    between, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    following = F.slice(between, F.lit(2), F.size(between))
    zipped = F.arrays_zip(between.alias("gap"), hits.alias("hit"), following.alias("next"))
    kind_of = "array<struct<start: int, stop: int, kind: string, value: string, before: string, after: string>>"
    empty = F.expr(f"cast(array() AS {kind_of})")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.struct(
            start.alias("start"),
            stop.alias("stop"),
            F.lit(kind).alias("kind"),
            x["hit"].alias("value"),
            F.right(x["gap"], F.lit(_CONTEXT)).alias("before"),
            F.left(F.coalesce(x["next"], F.lit("")), F.lit(1)).alias("after"),
        )
        more = F.when(x["hit"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(one)))
        return F.struct(stop.alias("at"), more.alias("found"))

    folded = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda s: s["found"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _any_word(text: Column, words: str) -> Column:
    return F.lower(text).rlike(rf"(?<![a-z])(?:{'|'.join(words.lower().split())})(?![a-z])")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _judged(x: Column) -> list[Column]:
    """Votes and features of a candidate, from its own text and what stands next to it."""
    kind, value, before, after = (x[c] for c in ("kind", "value", "before", "after"))
    digits = _digits(value)
    checked = {k: kind == k for k in KINDS}
    right = (
        F.when(checked["ip"], _is_base("ip", value))
        .when(checked["card"], _is_base("card", value))
        .when(checked["phone"], _is_base("phone", value))
        .when(checked["ssn"], ~value.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(checked["phone_national"], ~digits.rlike("^[01]"))
    )
    last = F.element_at(F.split(F.lower(value), r"[.\x20()\[\]]+"), -1)
    listed = (
        F.when(checked["email"] | checked["email_spelt"], F.when(last.isin(*TOP_DOMAINS.split()), 1).otherwise(-1))
        .when(checked["iban"], F.when(F.left(value, F.lit(2)).isin(*COUNTRIES.split()), 1).otherwise(-1))
        .when(checked["ip"], F.when(value.rlike(r"^(?:0|127|255)\."), -1).otherwise(0))
        .when(checked["name"] | checked["secret"], 1)
        .otherwise(0)
    )
    inside = before.rlike("[0-9A-Za-z]$") | after.rlike("^[0-9A-Za-z]")
    alone = (before.rlike(r"[\x20\n\t(:,;\x22]$") | (before == "")) & (after.rlike(r"^[\x20\n\t),.;:\x22]") | (after == ""))
    plain = digits.rlike(r"^(\d)\1*$") | digits.rlike("^0?123456789?")
    votes = [
        _vote(kind.isin("email", "phone", *LOOSE), F.length(digits).between(1, 6) & checked["card"]),
        F.when(right.isNull(), 0).when(right, 1).otherwise(-1),
        _vote(_any_word(before, CUES), _any_word(before, ANTI_CUES)),
        listed,
        _vote(alone, inside),
        _vote(F.lit(False), plain & (digits != "")),
    ]
    return [
        *[v.cast("int").alias(n) for v, n in zip(votes, VOTES, strict=True)],
        (F.length(value) > 15).cast("int").alias("f_long"),
        value.rlike(r"[\x20.()-]").cast("int").alias("f_separated"),
        ((before == "") | before.rlike("\n$")).cast("int").alias("f_opens_line"),
        value.rlike("[A-Za-z]").cast("int").alias("f_letters"),
    ]


def _passing(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda x: _is_base(kind, x["value"]))


def _plain(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("start", "stop", "kind")])


def _plain_spans(spans: Column) -> Column:
    return F.transform(spans, _plain)


def _number(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def candidates(docs: DataFrame) -> DataFrame:
    """Add ``_base``, the base spans, and ``_candidates``, every match of a base or loose pattern with
    its votes and features, to rows with ``_text``. All inside the row."""
    text = F.col("_text")
    matched = docs.withColumns({f"_{k}": _found(text, k, p) for k, p in (BASE | LOOSE).items()}).drop("_text")
    base = [_plain_spans(_passing(k)) for k in BASE]
    every = F.concat(*[F.col(f"_{k}") for k in KINDS])
    voted = F.transform(
        every,
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"), *_judged(x)),
    )
    kept = [c for c in docs.columns if c != "_text"]
    return matched.select(*kept, F.concat(*base).alias("_base"), voted.alias("_candidates"))


@dataclass(frozen=True)
class SpanClassifier:
    """The combinations of loose kind, votes and features that count as personal data."""

    accepted: tuple[str, ...]

    def accepts(self, x: Column) -> Column:
        return _pattern(x).isin(*self.accepted) if self.accepted else F.lit(False)


def _pattern(x: Column) -> Column:
    return F.concat_ws(",", x["kind"], *[x[f].cast("string") for f in FEATURES])


def fit_classifier(spans: DataFrame) -> SpanClassifier:
    """Train the span classifier on the label model's posteriors.

    Candidates are counted by kind, votes and features; only these counts are fitted, of which there
    are at most a few thousand combinations however many candidates. Expectation-maximisation over the
    votes gives each a probability, and a logistic regression from kinds and features, votes
    among them, learns these probabilities as weights of both classes.
    """
    counted = stage(
        spans.select(F.explode("_candidates").alias("x"))
        .select(_pattern(F.col("x")).alias("pattern"), "x.*")
        .groupBy("pattern", "kind", *FEATURES)
        .agg(F.count(F.lit(1)).alias("n")),
        "candidate_patterns",
    )
    if counted.isEmpty():
        return SpanClassifier(())
    repeated = counted.select(*VOTES, "n")
    model = fit_label_model(repeated, VOTES, prior=0.5, weight="n")
    p = model.posterior()
    kinds = [(F.col("kind") == k).cast("double").alias(f"k_{k}") for k in KINDS]
    wide = counted.select("pattern", "n", p.alias("p"), *kinds, *[F.col(f).cast("double") for f in FEATURES])
    both = wide.withColumn("side", F.explode(F.array(F.lit(1.0), F.lit(0.0)))).withColumn(
        "weight", F.col("n") * F.when(F.col("side") == 1, F.col("p")).otherwise(1 - F.col("p")) + 1e-6
    )
    assembler = VectorAssembler(inputCols=[*[f"k_{k}" for k in KINDS], *FEATURES], outputCol="features")
    learner = LogisticRegression(labelCol="side", weightCol="weight", maxIter=30, regParam=1e-3)
    fitted = learner.fit(assembler.transform(both))
    # A base match that fails its check teaches what is none, and is never added.
    loose = wide.join(counted.filter(F.col("kind").isin(*LOOSE)).select("pattern"), "pattern", "left_semi")
    scored = fitted.transform(assembler.transform(loose)).filter("prediction = 1").select("pattern").collect()
    return SpanClassifier(tuple(sorted(r.pattern for r in scored)))


def find_pii(docs: DataFrame) -> DataFrame:
    """Add ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` and ``base_spans``, ``spans`` to every row.

    Both are arrays of (start, stop, kind) by start, then kind; positions are code points of the whole
    text, stop exclusive. Base spans are the matches of the four base patterns that pass their check.
    ``spans`` holds them and the candidates that the trained classifier accepts and that overlap no base
    span nor an earlier accepted one.

    Candidates are found, and spans chosen, inside the row; only counts of vote patterns are shuffled.
    Candidates, without texts, are written to the shared folder between the two steps.

    A null text counts as an empty one, without spans; repeated rows get the same spans; an empty
    table stays empty; other columns are passed on, one named like a result is replaced.
    """
    rows = carried(docs).withColumn("_text", F.coalesce("_row.text", F.lit("")))
    return _with_spans(stage(candidates(rows), "pii_candidates"), docs.columns)


def find_pii_ids(docs: DataFrame) -> DataFrame:
    """``find_pii`` with doc_id as the only column passed on."""
    rows = docs.select(F.struct("doc_id").alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    return _with_spans(stage(candidates(rows), "pii_candidates"), ["doc_id"])


def _with_spans(found: DataFrame, names: list[str]) -> DataFrame:
    classifier = fit_classifier(found)

    def ordered(spans: Column) -> Column:
        keyed = F.transform(
            spans,
            lambda x: F.struct(
                x["start"].alias("start"),
                F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).alias("place"),
                x["stop"].alias("stop"),
                x["kind"].alias("kind"),
            ),
        )
        return _plain_spans(F.array_sort(keyed))

    def apart(x: Column, others: Column) -> Column:
        return ~F.exists(others, lambda b: (x["start"] < b["stop"]) & (b["start"] < x["stop"]))

    wanted = F.filter("_candidates", lambda x: classifier.accepts(x) & apart(x, F.col("_base")))
    added = F.aggregate(
        ordered(wanted),
        F.expr("cast(array() AS array<struct<start: int, stop: int, kind: string>>)"),
        lambda a, x: F.when(apart(x, a), F.concat(a, F.array(x))).otherwise(a),
    )
    counts = {f"n_{k}": _number("_base", k) for k in BASE}
    done = found.withColumn("_added", added).select(
        "_row",
        *[c.alias(n) for n, c in counts.items()],
        ordered(F.col("_base")).alias("base_spans"),
        ordered(F.concat("_base", "_added")).alias("spans"),
    )
    return unpacked(done, names, [*counts, "base_spans", "spans"])


def written(spans: str) -> Column:
    """kind:start:stop of all spans, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )
