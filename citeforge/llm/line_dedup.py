"""Line deduplication by a log-template tree.

Native: DataFrame functions only. A line falls down a tree of fixed depth: by its number of tokens,
then by its leading tokens, variable fields (tokens with a digit) masked. In a leaf, a position is
constant where one token has a large enough share of the leaf's lines, else it is a variable field;
the line's template is its constant tokens in place. Templates that stand in many different texts
are boilerplate, and their lines go. Of the tokens after the leading ones, which all lines of a leaf
share, a template must keep enough: else a common opening would make boilerplate of unique prose. The
whole line, only its variable fields masked, is a template too, so that a line which has too small a
share of its leaf is found; shorter lines can only be judged so (``shortest``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.llm.columns import id_and_text
from citeforge.llm.scratch import apart, release, written


@dataclass(frozen=True)
class LogTree:
    """``leading``: tokens that the tree branches on, after the count. ``texts``: different texts
    in which a template must stand to go. ``share``: of a leaf's lines, for a constant token.
    ``constant``: least constant tokens of a template, or all tokens of a shorter line. ``loose``:
    largest share of the tokens after the leading ones that a template masks though they have no
    digit. ``shortest``: tokens from which lines are judged; with 1 every line is, those of under
    ``constant`` tokens as a whole."""

    leading: int = 3
    texts: int = 10
    share: float = 0.3
    constant: int = 3
    loose: float = 0.5
    shortest: int = 3


FIELD = "<*>"


def spaced(line: Column) -> Column:
    """A line whose tokens stand one space apart. Few lines need it, so plain searches come first."""
    odd = line.startswith(" ") | line.endswith(" ")
    for gap in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | line.contains(gap)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), F.lit(FIELD)).otherwise(token)


def n_tokens(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def tokens(line: Column) -> Column:
    """Tokens of a spaced line, those with a digit masked."""
    return F.transform(F.split(line, " "), masked)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: LogTree | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (the other lines).

    A template is counted once for each different text, so copies of a document don't make its
    lines boilerplate. Lines end at \\n; those of under ``shortest`` tokens stay.
    Null and empty texts are one empty line. Null ids are told apart by their text. Rows that
    repeat an id and a text get the same result. Columns besides the two are ignored.

    Counts are combined in the tasks before every shuffle, and only leaves that occur in enough
    texts carry their lines on, by joins that AQE may split; a leaf with a third of all lines
    never meets in one task.
    """
    tree = tree or LogTree()
    rows = id_and_text(docs, id_col, text_col)
    same = F.xxhash64("text")  # with the id: the document; alone: the text
    lines = rows.select("doc_id", same.alias("tag"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    least = max(tree.shortest, 1)
    lines = lines.filter(F.length("line") > 2 * (least - 1)).withColumn("line", spaced(F.col("line")))
    lines = lines.filter((F.length("line") > 0) & (n_tokens(F.col("line")) >= least))
    # Only the leading tokens are taken apart here; most lines never need more.
    head = F.split("line", " ", tree.leading + 1)
    lines = lines.withColumn("leaf", F.xxhash64(n_tokens(F.col("line")), *(masked(F.get(head, F.lit(i))) for i in range(tree.leading))))

    often = lines.groupBy("leaf", "tag").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
    often = written(often.filter(F.col("texts") >= tree.texts).select("leaf", "n"), "frequent_leaves")
    release(docs.sparkSession)
    held = written(lines.join(often.select("leaf"), "leaf", "left_semi"), "leaf_lines")
    release(docs.sparkSession)

    held = held.withColumn("tokens", tokens(F.col("line")))
    at = held.select("leaf", F.posexplode("tokens").alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count(F.lit(1)).alias("m"))
    fixed = at.join(apart(often), "leaf").filter(F.col("m") >= tree.share * F.col("n"))
    # At most 1 / share tokens for each position of a leaf's lines, which all have one length.
    fixed = fixed.groupBy("leaf").agg(F.collect_set(F.concat_ws(" ", F.col("at").cast("string"), "token")).alias("fixed"))
    template = F.transform("tokens", lambda t, i: F.when(F.array_contains("fixed", F.concat_ws(" ", i.cast("string"), t)), t).otherwise(F.lit(FIELD)))
    shaped = held.join(apart(fixed), "leaf", "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<string>"))).withColumn("masked", template)
    constant = lambda c: F.size(F.filter(c, lambda t: t != FIELD)) >= F.least(F.size(c), F.lit(tree.constant))
    loose = F.size(F.filter(F.col("tokens"), lambda t: t != FIELD)) - F.size(F.filter(F.col("masked"), lambda t: t != FIELD))
    close = loose <= tree.loose * (F.size("tokens") - tree.leading)
    partly = F.when(constant(F.col("masked")) & ((loose == 0) | close), F.xxhash64("leaf", "masked"))
    whole = F.when(constant(F.col("tokens")), F.xxhash64("leaf", "tokens"))
    shaped = shaped.select("doc_id", "tag", "i", F.explode(F.array_distinct(F.array_compact(F.array(partly, whole)))).alias("template"))
    shaped = written(shaped, "line_templates")
    common = shaped.groupBy("template", "tag").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("texts"))
    gone = shaped.join(apart(common.filter(F.col("texts") >= tree.texts)), "template", "left_semi")
    gone = gone.groupBy("doc_id", "tag").agg(F.collect_set("i").alias("gone"))

    split = F.split("text", "\n")
    kept = F.when(F.col("gone").isNull(), split).otherwise(F.filter(split, lambda _, i: ~F.array_contains("gone", i)))
    keyed = rows.withColumn("tag", same)
    joined = keyed.join(gone.withColumnsRenamed({"doc_id": "id", "tag": "t"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("t")), "left")
    return joined.select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone").cast("long"), F.lit(0)).alias("n_removed"),
        F.array_join(kept, "\n").alias("kept"),
    ).withColumn("n_removed", F.greatest("n_removed", F.lit(0)))


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, and the digest of the kept text."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
