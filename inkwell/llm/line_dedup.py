"""Line dedup over a suffix array of line identifiers.

Texts become sequences of line identifiers.  Prefix doubling sorts the suffixes
of all sequences by their first 1, 2, 4, ... lines until no two are tied: each
round range-sorts the pairs of ranks of a suffix and of the one `width` lines
on, and numbers them in that order.  Suffixes that share a rank are an interval
of the suffix array whose longest common prefix has at least `width` lines.

A suffix is a later copy in every interval that has an earlier member.  The
widest of these names its source, the first occurrence; neighbouring suffixes
whose sources are neighbours too are one maximal repeated run, which ends where
the last one's common prefix ends.  Later copies of runs are deleted.

Two things keep the array small.  A line that occurs once ends every common
prefix, so suffixes that start at one are left out; and of the others, those
whose prefix has become unique leave after each round.  DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import bound
from inkwell.llm.common import discard, join_hot, materialize

#: Lines of the shortest run that is deleted.
MIN_LINES = 2
#: A single repeated line is deleted too if it has this many words.
MIN_WORDS = 5

_SPACE = r"[\x20\x09-\x0D]"
_OTHER = r"[^\x20\x09-\x0D]"
#: A sequence: whether its text has an identifier, which (null comes first), and a hash that tells texts with one identifier apart.
SEQUENCE = ["has", "doc", "h"]
#: A suffix: its sequence and the number of its first line, of those with a word.
PLACE = [*SEQUENCE, "nth"]


def _sequence(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.isNotNull().alias("has"), F.coalesce(doc_id, F.lit(0)).alias("doc"), F.xxhash64(text).alias("h")]


def _worded(text: Column) -> Column:
    """(pos, line) of the lines with a word."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line"))), lambda x: x["line"].rlike(_OTHER))


def line_sequences(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(PLACE, line, wordy) for each line with a word; line is a 128-bit digest."""
    many = rf"^{_SPACE}*+(?:{_OTHER}++{_SPACE}++){{{min_words - 1}}}{_OTHER}" if min_words > 1 else _OTHER
    text = F.col(text_col)
    each = docs.select(*_sequence(F.col(id_col).cast("long"), text), F.posexplode(_worded(text)).alias("nth", "at"))
    return each.select(*PLACE, F.unhex(F.md5("at.line")).alias("line"), F.col("at.line").rlike(many).alias("wordy"))


def _rank(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes whose `keys` occur twice or more, with rank (ordered as the keys) and the first place that has them."""
    groups = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*PLACE)).alias("first")).filter("copies > 1")
    # Numbers rise along the range partitions and within them.
    groups = groups.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    groups = materialize(groups, "ranks")
    level = materialize(join_hot(suffixes, groups, keys, "copies").drop(*keys), "suffixes")
    discard(groups)
    return level


def _pairs(level: DataFrame, shift: int) -> DataFrame:
    """Suffixes with their rank and that of the suffix `shift` lines on, where there is one that is repeated too."""
    on = Window.partitionBy(*SEQUENCE).orderBy("nth").rangeBetween(shift, shift)
    return level.select(*PLACE, F.col("rank").alias("own"), F.first("rank").over(on).alias("next")).filter("next is not null")


def suffix_levels(lines: DataFrame, min_lines: int) -> list[tuple[int, DataFrame]]:
    """(width, suffixes) for widths that double, and `min_lines` among them, while two suffixes share their first `width` lines.

    The suffixes have PLACE, rank and first; ranks of one width order them by their first `width` lines.
    """
    # Rows that repeat a text and its identifier are one sequence.
    if not lines.filter("nth = 0").groupBy(*SEQUENCE).count().filter("count > 1").isEmpty():
        lines = materialize(lines.distinct(), "lines")
    level, width, levels = _rank(lines, ["line"]), 1, []
    while not level.isEmpty():
        levels.append((width, level))
        shift = min(width, min_lines - width) if width < min_lines else width
        pairs = materialize(_pairs(level, shift), "pairs")
        level = _rank(pairs, ["own", "next"])
        discard(pairs)
        width += shift
    discard(level)
    return levels


def later_runs(levels: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame:
    """Later copies of repeated runs of `min_lines` lines and more: SEQUENCE, from, to (counts of lines with a word) and source, the place of the first copy."""
    later = F.struct(*PLACE) > F.col("first")
    copies = [x.filter(later).select(*PLACE, F.struct(F.lit(w).alias("width"), "first").alias("top")) for w, x in levels if w >= min_lines]
    # All of a sequence is in one task from here on, so this is the only shuffle.
    widest = reduce(DataFrame.union, copies).repartition(*SEQUENCE).groupBy(*PLACE).agg(F.max("top").alias("top")).select(*PLACE, "top.width", "top.first")
    along = Window.partitionBy(*SEQUENCE).orderBy("nth")
    before = F.lag(F.struct("nth", *[F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE])).over(along)
    goes_on = (before["nth"] == F.col("nth") - 1) & (before["first_nth"] == F.col("first.nth") - 1)
    for c in SEQUENCE:
        goes_on &= before[f"first_{c}"] == F.col(f"first.{c}")
    runs = widest.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(along)).groupBy(*SEQUENCE, "run")
    return runs.agg(F.min("nth").alias("from"), F.max(F.col("nth") + F.col("width")).alias("to"), F.min_by("first", "nth").alias("source")).drop("run")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """Later copies of maximal repeated line runs: doc_id, from, to, source_id, source_from, of lines with a word.

    Lines from..to-1 of a text repeat those of the source from source_from on.  See `line_dedup` for
    the order of texts and the cases.
    """
    levels = suffix_levels(materialize(line_sequences(docs, id_col, text_col, 1), "lines"), min_lines)
    if not any(w >= min_lines for w, _ in levels):
        return docs.sparkSession.createDataFrame([], "doc_id long, from int, to int, source_id long, source_from int")
    runs, source = later_runs(levels, min_lines), F.col("source")
    return runs.select(F.when(F.col("has"), F.col("doc")).alias("doc_id"), "from", "to", F.when(source["has"], source["doc"]).alias("source_id"), source["nth"].alias("source_from"))


def _deleted(lines: DataFrame, min_lines: int) -> DataFrame:
    """(SEQUENCE, spans): the spans (from, to) of lines with a word that go; none touches the next."""
    levels = suffix_levels(lines.drop("wordy"), min_lines)
    found = [later_runs(levels, min_lines).select(*SEQUENCE, "from", "to")] if any(w >= min_lines for w, _ in levels) else []
    if levels and min_lines > 1:
        single = levels[0][1].filter(F.struct(*PLACE) > F.col("first")).join(lines.filter("wordy").select(*PLACE), PLACE)
        found.append(single.select(*SEQUENCE, F.col("nth").alias("from"), (F.col("nth") + 1).alias("to")))
    if not found:
        return lines.sparkSession.createDataFrame([], "has boolean, doc long, h long, spans array<struct<from:int,to:int>>")
    order = Window.partitionBy(*SEQUENCE).orderBy("from", F.col("to").desc())
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = (
        reduce(DataFrame.union, found)
        .withColumn("opens", F.when(F.col("from") <= before, 0).otherwise(1))
        .withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*SEQUENCE, "span")
        .agg(F.min("from").alias("from"), F.max("to").alias("to"))
        .groupBy(*SEQUENCE)
        .agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("spans"))
    )
    spans = materialize(spans, "spans")
    for _, level in levels:
        discard(level)
    return spans


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the later copies of repeated line runs; n_lines and n_deleted are appended.

    A run counts from `min_lines` lines on, or as one line of `min_words` words.  Runs are looked
    for within and across texts; the occurrence in the text with the smallest identifier, and there
    the first, stays.  Lines are split at \\n; a line without a word belongs to no run and goes only
    with the lines around it.  No row is dropped: a text of nothing but later copies becomes empty.

    A null text stays null with 0 lines; an empty text has one line.  A null identifier comes
    before all others.  Rows that repeat an identifier and its text are one text, and all get its
    result; different texts with one identifier are told apart.  Columns of `docs` are kept,
    whatever their names; columns named n_lines or n_deleted are replaced.  An empty table gives
    an empty result.
    """
    lines = materialize(line_sequences(docs, id_col, text_col, min_words), "lines")
    spans = _deleted(lines, min_lines)
    discard(lines)
    rows = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    keyed = rows.select("row", *_sequence(F.col("row").getField(id_col).cast("long"), text))
    joined = keyed.join(spans, SEQUENCE, "left")
    parts = F.split(text, "\n")
    # From the first line of a span to its last, with what lies between.
    pos = F.transform(_worded(text), lambda x: x["pos"])
    cuts = bound(pos, lambda p: F.transform("spans", lambda x: F.struct(F.get(p, x["from"]).alias("from"), (F.get(p, x["to"] - 1) + 1).alias("to"))))
    joined = joined.withColumn("cuts", F.when(F.col("spans").isNotNull(), cuts))
    # What lies between the deleted spans.
    starts = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda x: x["to"]))
    ends = F.concat(F.transform("cuts", lambda x: x["from"]), F.array(F.size(parts)))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] > x["a"])
    left = F.flatten(F.transform(gaps, lambda x: F.slice(parts, x["a"] + 1, x["b"] - x["a"])))
    gone = F.aggregate("cuts", F.lit(0), lambda s, x: s + x["to"] - x["from"])
    cut = F.when(F.col("cuts").isNull(), text).otherwise(F.concat_ws("\n", left))
    same = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_deleted")]
    out = joined.select(
        *same,
        cut.alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_deleted"),
    )
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_deleted")], "n_lines", "n_deleted")
