"""Cutting oversized texts at natural boundaries with a regular expression of bounded quantifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.session import free_name

#: What may stand before a cut, from strong to weak: blank line, line break, sentence end, clause end.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,9}\n\p{IsWhite_Space}{0,9})",
    r"(?<=\n\p{IsWhite_Space}{0,9})",
    r"(?<=[.!?।]['\")\]]{0,2}\p{IsWhite_Space}{1,9})(?<!\b(?:Rs|No|Dr|Mr|Mrs|Ms|Smt)\.\p{IsWhite_Space}{1,9})",
    r"(?<=[;:,]\p{IsWhite_Space}{1,9})",
)
WORD = r"\P{IsWhite_Space}++\p{IsWhite_Space}*+"
CHARACTER = r"(?s:.)"


def cut_pattern(first: int, rest: int, unit: str, least: float) -> str:
    """Alternatives for one cut: all that remains, each boundary from strong to weak, then the bare limit.

    ``first`` and ``rest`` are the most units the first cut and every further one may take; a boundary
    is taken only when at least the share ``least`` of the limit lies before it. For characters a blank is
    the last boundary, and any character the fallback.
    """
    boundaries = (*BOUNDARIES, r"(?<=\p{IsWhite_Space})") if unit == CHARACTER else BOUNDARIES
    parts = []
    for anchor, most in ((r"\A", first), ("", rest)):
        low = max(1, min(most, int(most * least)))
        parts.append(rf"{anchor}(?:{unit}){{1,{most}}}\z")
        parts += [rf"{anchor}(?:{unit}){{{low},{most}}}{b}" for b in boundaries]
        parts.append(rf"{anchor}(?:{unit}){{1,{most}}}")
    return "|".join(parts)


def split_oversized(
    df: DataFrame,
    text_col: str,
    limit: int = 300,
    overlap: int = 60,
    by: str = "words",
    start_col: str | None = None,
    overlap_col: str | None = None,
    least: float = 0.6,
) -> DataFrame:
    """Pieces of the rows whose text is over ``limit`` words (or characters); other rows are not returned.

    A regular expression cuts the text into stretches at the strongest boundary near the limit, and
    each piece but the first begins ``overlap`` units before its stretch. Words are runs of characters
    other than Unicode white space. Columns of ``df`` stay, and these are added (with an underscore
    where the name is taken, unless it is ``start_col`` or ``overlap_col``, which are replaced):
    ``piece_index`` from 0, ``piece_text``, ``piece_words`` (units in it), ``start_word`` (the row's own
    start, null as 0, plus the units before the piece) and ``previous_overlap`` (``overlap``; for the
    first piece the row's own value where it is between 0 and ``overlap``, else 0). Null and empty texts,
    and texts within the limit, give no piece; leading white space is dropped.
    """
    if not 0 <= overlap < limit * least:
        raise ValueError("the overlap must be smaller than the shortest stretch")
    unit = WORD if by == "words" else CHARACTER
    idx, piece, count = free_name(df, "piece_index", "piece_text", "piece_words")
    start = start_col or free_name(df, "start_word")[0]
    prev = overlap_col or free_name(df, "previous_overlap")[0]
    stripped = F.regexp_replace(F.col(text_col), r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "") if by == "words" else F.col(text_col)
    shortest = 2 * limit if by == "words" else limit
    over = (F.length(text_col) > shortest) & (_units(F.col(text_col), by) > limit)
    pattern = cut_pattern(limit, limit - overlap, unit, least)
    base = df.where(over).withColumn("__t", stripped)
    base = base.withColumn("__units", F.regexp_extract_all("__t", F.lit(unit), F.lit(0)))
    base = base.withColumn("__stretch", F.transform(F.regexp_extract_all("__t", F.lit(pattern), F.lit(0)), lambda s: _units(s, by)))
    ends = F.aggregate(
        "__stretch",
        F.array().cast("array<int>"),
        lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)),
    )
    out = base.withColumn("__ends", ends).select("*", F.posexplode("__ends").alias("__i", "__end"))
    begin = F.when(F.col("__i") == 0, F.lit(0)).otherwise(F.expr("__ends[__i - 1]") - overlap)
    out = out.withColumn("__begin", begin)
    text = F.array_join(F.slice("__units", F.col("__begin") + 1, F.col("__end") - F.col("__begin")), "")
    own = F.coalesce(F.col(start_col), F.lit(0)) if start_col else F.lit(0)
    first = F.lit(0)
    if overlap_col:
        first = F.when(F.col(overlap_col).between(0, overlap), F.col(overlap_col)).otherwise(0)
    return out.select(
        *[c for c in df.columns if c not in (start_col, overlap_col)],
        F.col("__i").alias(idx),
        (F.regexp_replace(text, r"\p{IsWhite_Space}+\z", "") if by == "words" else text).alias(piece),
        (F.col("__end") - F.col("__begin")).alias(count),
        (own + F.col("__begin")).cast("int").alias(start),
        F.when(F.col("__i") == 0, first).otherwise(F.lit(overlap)).cast("int").alias(prev),
    )


def _units(text: Column, by: str) -> Column:
    return F.regexp_count(text, F.lit(r"\P{IsWhite_Space}++")) if by == "words" else F.length(text)
