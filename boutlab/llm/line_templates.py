"""Line dedup by a fixed-depth tree of log templates, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boutlab.llm.common import SPACE, SPACES, unpacked
from boutlab.sources.tables import stage

# Leading tokens below the level of token counts.
DEPTH = 3
# Shorter lines have no template: they recur by chance.
MIN_TOKENS = 5
# Least share of a template's places that hold a literal token.
LITERAL = 0.6
VARIABLE = "<*>"
_NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def masked_lines(docs: DataFrame) -> DataFrame:
    """(doc, row, no, leaf, masked) of every line long enough for a template.

    ``masked`` holds the line's tokens, one space apart, those with a digit replaced; ``leaf`` is the hash
    of the path in the tree: number of tokens, then the leading ones. ``row`` tells apart rows that
    share a doc_id.
    """
    lines = docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("row"),
        F.posexplode(F.split("text", "\n")).alias("no", "line"),
    )
    variable = F.when(F.col("line").rlike("[0-9]"), F.regexp_replace("line", _NUMBERED, VARIABLE))
    tokens = F.split(F.btrim(F.coalesce(variable, "line"), F.lit(SPACES)), SPACE)
    # Exploded, so that no filter on the tokens is moved below them and splits every line again.
    once = lines.select("doc", "row", "no", F.explode(F.array(tokens)).alias("tokens"))
    cut = once.filter(F.size("tokens") >= MIN_TOKENS)
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, DEPTH))
    return cut.select("doc", "row", "no", leaf.alias("leaf"), F.array_join("tokens", " ").alias("masked"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc, row, no) of the lines to drop: all of a recurring template but its first occurrence."""
    # Parsed once: read for the leaves and again for the lines of shared ones.
    lines = stage(masked_lines(docs), "masked_lines")
    several = F.col("low") < F.col("high")
    leaves = lines.groupBy("leaf").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    # Only leaves that several documents reach can hold a recurring template; most lines end here.
    # Written first: joined to stored rows, a hot leaf's lines can be split.
    shared = stage(leaves.filter(several).select("leaf"), "shared_leaves")
    reached = lines.join(shared, "leaf", "left_semi")
    known = stage(reached.withColumn("id", F.md5(F.concat_ws(" ", F.col("leaf").cast("string"), "masked"))), "lines")
    distinct = stage(
        known.groupBy("id").agg(
            F.first("leaf").alias("leaf"),
            F.first("masked").alias("masked"),
            F.min("doc").alias("low"),
            F.max("doc").alias("high"),
            F.min(F.struct("doc", "no")).alias("first"),
        ),
        "distinct_lines",
    )
    # Below the leaf, a token is literal where several documents have it at that place; the leading
    # ones are so by the path. A line that recurs as it is has literal tokens only.
    single = distinct.filter(~several).select("id", "leaf", "low", F.split("masked", " ").alias("tokens"))
    places = distinct.select("leaf", "low", "high", F.posexplode(F.split("masked", " ")).alias("at", "token"))
    key = F.xxhash64("leaf", "at", "token").alias("key")
    literal = (
        places.filter(F.col("at") >= DEPTH)
        .select(key, "low", "high")
        .groupBy("key")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .filter(several)
        .select("key")
    )
    literal = stage(literal, "literal_tokens")
    own = single.select("id", "leaf", F.posexplode("tokens").alias("at", "token")).filter(
        (F.col("at") >= DEPTH) & (F.col("token") != VARIABLE)
    )
    free = own.select("id", "at", key).join(literal, "key", "left_anti")
    fields = free.groupBy("id").agg(F.collect_set("at").alias("fields"))
    template = F.transform("tokens", lambda t, i: F.when(F.array_contains("fields", i), VARIABLE).otherwise(t))
    generalised = single.join(fields, "id", "left").select(
        "id", F.coalesce(F.when(F.col("fields").isNotNull(), template), "tokens").alias("tokens")
    )
    shapes = (
        distinct.join(generalised, "id", "left")
        .withColumn("tokens", F.coalesce("tokens", F.split("masked", " ")))
        .withColumn("literals", F.size(F.filter("tokens", lambda t: t != VARIABLE)))
        .filter(F.col("literals") >= F.lit(LITERAL) * F.size("tokens"))
        .select("id", "low", "high", "first", F.md5(F.concat_ws(" ", F.col("leaf").cast("string"), F.array_join("tokens", " "))).alias("shape"))
    )
    shapes = stage(shapes, "line_shapes")
    recurring = (
        shapes.groupBy("shape")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"))
        .filter(several)
        .select("shape", "first")
    )
    recurring = stage(recurring, "recurring_templates")
    dropped = stage(shapes.select("id", "shape").join(recurring, "shape").select("id", "first"), "recurring")
    return (
        known.select("id", "doc", "row", "no")
        .join(dropped, "id")
        .filter((F.col("doc") != F.col("first.doc")) | (F.col("no") != F.col("first.no")))
        .select("doc", "row", "no")
    )


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """Take out of every text the lines whose template occurs in several documents.

    Lines are parsed by a tree of fixed depth: the number of tokens, then ``DEPTH`` leading tokens,
    where a token with a digit stands for any. In a leaf, places whose token no second document has are
    variable fields. A template that lines of at least two documents share, and whose places are
    literal for ``LITERAL`` or more, recurs: its first line (least doc_id, then line number) stays,
    all others go. Lines of fewer than ``MIN_TOKENS`` tokens have no template and stay.

    ``text`` is replaced and ``n_dropped`` (long) added. Lines are shuffled once by leaf, and texts once by
    doc_id to lose their lines; hot lines and templates are counted before they are shuffled, and
    joined to one row each, which Spark's skew join splits.

    A null text stays null and an empty one empty; a text that loses all lines becomes empty; rows of
    one doc_id are one document; null doc_ids are one document too; an empty table stays empty; other
    columns are passed on.
    """
    gone = stage(
        recurring_lines(docs.select("doc_id", "text"))
        .groupBy("doc", "row")
        .agg(F.collect_set("no").alias("gone")),
        "dropped_lines",
    )
    # Places that stay, by a hash set; a search of the dropped ones for every line would be quadratic.
    places = F.sequence(F.lit(0), F.size(F.col("_lines")) - 1)
    stay = F.array_except(places, "gone")
    keyed = docs.select(
        F.struct("*").alias("_row"),
        F.col("text").alias("_text"),
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("row"),
    )
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    found = keyed.join(gone, ["doc", "row"], "left").select(
        "_row", "_text", "gone", F.explode(F.array(F.when(F.col("gone").isNotNull(), F.split("_text", "\n")))).alias("_lines")
    )
    cleaned = found.select(
        "_row",
        F.when(F.col("gone").isNull(), F.col("_text")).otherwise(left).alias("text"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return unpacked(cleaned, docs.columns, ["text", "n_dropped"])


def drop_recurring_lines_sql(table: str = "documents") -> str:
    """(doc_id, text, n_dropped) of the same answer as a query for DuckDB, for unique doc_ids."""
    space = r"[\x20\x09-\x0D]+"
    return f"""
        WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM {table}),
        lines AS (SELECT doc_id, i - 1 AS no, p[i] AS line
            FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
        cut AS (SELECT doc_id, no, list_transform(
                list_filter(regexp_split_to_array(line, '{space}'), lambda x: x <> ''),
                lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{VARIABLE}' ELSE x END) AS t FROM lines),
        leafed AS (SELECT *, len(t) AS n, t[1:{DEPTH}] AS lead FROM cut WHERE len(t) >= {MIN_TOKENS}),
        places AS (SELECT doc_id, no, n, lead, i, t[i] AS token
            FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM leafed)),
        literal AS (SELECT n, lead, i, token FROM places WHERE i > {DEPTH}
            GROUP BY ALL HAVING min(doc_id) < max(doc_id)),
        shaped AS (SELECT p.doc_id, p.no, p.n, p.lead, list(CASE
                WHEN p.i <= {DEPTH} OR l.token IS NOT NULL THEN p.token ELSE '{VARIABLE}' END ORDER BY p.i) AS t
            FROM places p LEFT JOIN literal l USING (n, lead, i, token) GROUP BY ALL),
        good AS (SELECT * FROM shaped
            WHERE len(list_filter(t, lambda x: x <> '{VARIABLE}')) >= {LITERAL} * n),
        recurring AS (SELECT n, lead, t, min({{'d': doc_id, 'n': no}}) AS first FROM good
            GROUP BY n, lead, t HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT doc_id, no FROM good JOIN recurring r USING (n, lead, t)
            WHERE doc_id <> r.first.d OR no <> r.first.n)
        SELECT d.doc_id, CASE WHEN count(g.no) = 0 THEN any_value(d.text) ELSE coalesce(string_agg(
                CASE WHEN g.no IS NULL THEN l.line END, chr(10) ORDER BY l.no), '') END AS text,
            count(g.no) AS n_dropped
        FROM {table} d LEFT JOIN lines l ON l.doc_id = d.doc_id
            LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.no = l.no
        GROUP BY d.doc_id"""
