"""Text cleaning: from column to column, in one projection each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regulus.functions import patterns as P
from regulus.functions.text import drop_lines, lines, replace_all, strip, unlines


def page_artifacts(c: Column) -> Column:
    """Without lines such as a running head with its page number; then at most one blank line in a row."""
    return replace_all(drop_lines(c, P.PAGE_ARTIFACT), (r"\n{3,}", "\n\n"))


def page_dividers(c: Column) -> Column:
    """Without page marks and ruled lines; blank lines stay."""
    return drop_lines(c, P.PAGE_DIVIDER)


def divider_count(c: Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: strip(x).rlike(P.PAGE_DIVIDER)))


def article_body(c: Column) -> Column:
    """Without the head of the next chapter, with lost clause numbers restored and spacing evened."""
    return strip(replace_all(c, *P.BODY_RULES))


def annex_markdown(c: Column) -> Column:
    """An annex for reading: without box drawing and private-use signs."""
    return strip(replace_all(F.translate(c, P.MARKDOWN_BOX, ""), (r"[-]", ""), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def annex_canonical(c: Column) -> Column:
    """An annex for segmentation: without list and box signs, each line evened."""
    clean = F.translate(c, P.CANONICAL_SIGNS, "")
    split = F.split(clean, "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c-\\u001e\\u0085\\u2028\\u2029]", -1)
    return strip(unlines(F.transform(split, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s+$", ""))))


def law_spacing(c: Column) -> Column:
    """Numbers with their units, and particles with a space after them."""
    c = replace_all(c, *P.SPACING_RULES)
    return replace_all(c, *[(rf"([가-힣]+)\s?{p}\s?([가-힣]+)", f"$1{p} $2") for p in P.PARTICLES])


def post_merge(c: Column) -> Column:
    """Without code fences and page marks, all white space evened."""
    c = replace_all(c, (P.CODE_FENCE, ""), (P.CODE_FENCE_END, ""), *[(p, "") for p in P.PAGE_MARKERS])
    return strip(replace_all(c, (r"\s{2,}", " "), (r"\n{3,}", "\n\n")))


def line_breaks(c: Column) -> Column:
    return replace_all(c, (" {2,}", " "), (r"\n{3,}", "\n\n"))


def golden(c: Column) -> Column:
    """The form in which golden texts are compared."""
    return strip(replace_all(c, (r"(?U)\s+", " "), (r"(?U)[^\w\s(),.\-①-⑳]", "")))


def checksum(c: Column) -> Column:
    return F.md5(F.encode(c, "UTF-8"))


def squeezed(c: Column, most: int = 1000) -> Column:
    return F.substring(strip(F.regexp_replace(c, r"\s+", " ")), 1, most)


def repaired_numbers(text: Column, scan: Column) -> Column:
    """Article numbers beyond the range are page numbers misread; the first one in range of the scan stands for them."""
    no = lambda x: F.regexp_extract(x, P.ARTICLE_NUMBER, 1).cast("decimal(38,0)")

    def written(x: Column) -> Column:
        again = F.regexp_extract(x, P.ARTICLE_NUMBER, 2)
        return F.concat(F.lit("제"), F.regexp_extract(x, P.ARTICLE_NUMBER, 1), F.lit("조"), F.when(again != "", F.concat(F.lit("의"), again)).otherwise(F.lit("")))

    right = F.get(F.filter(F.regexp_extract_all(scan, F.lit(P.ARTICLE_NUMBER), F.lit(0)), lambda x: no(x) <= P.LAST_ARTICLE), 0)
    wrong = F.transform(F.filter(F.regexp_extract_all(text, F.lit(P.ARTICLE_NUMBER), F.lit(0)), lambda x: no(x) > P.LAST_ARTICLE), written)
    return F.when(right.isNull(), text).otherwise(F.aggregate(wrong, text, lambda a, w: F.replace(a, w, written(right))))


def page_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(P.PAGE_NUMBER), F.lit(0))


def kvs_value(c: Column) -> Column:
    """A value with its first long number grouped, a leading time as HH:MM alone, and units set close."""
    v = strip(c)
    digits = F.regexp_extract(v, r"\d{4,}", 0)
    grouped = F.regexp_replace(F.regexp_replace(digits, "^0+(?=.)", ""), r"\B(?=(\d{3})+$)", ",")
    v = F.when(digits != "", F.replace(v, digits, grouped)).otherwise(v)
    hour = F.regexp_extract(v, r"^(\d{1,2}):(\d{2})", 1)
    v = F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(v, r"^(\d{1,2}):(\d{2})", 2))).otherwise(v)
    for unit in P.CLOSE_UNITS:
        v = F.replace(v, F.lit(f" {unit}"), F.lit(unit))
    return v
