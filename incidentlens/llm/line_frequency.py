"""Line dedup by site-relative frequency: lines on too many pages of a host are boilerplate.

Pages are counted once per host and line; the ratio is that count over the host's pages. The lines
above the ratio of one host are at most (mean lines of its pages) / ratio, so they fit one array per
host; pages then filter their own lines against it, and no page is ever taken apart and put together
again. A host with most pages is an ordinary case: counts are combined before the shuffle, and on the
way back the arrays are either broadcast, if all of them together are at most `BROADCAST_BYTES`, or
copied to `SALTS` parts of each host.

Defined results: a null text stays null and counts as a page without lines; empty lines are kept and
never counted; null hosts are one host; repeated rows are pages of their own; a line repeated on one
page counts once, and all its copies on a page are dropped or kept together. The ratio decides on hosts of any
size; only a line on a single page is never boilerplate, as nothing repeats it. A page is one value and is
held whole, a few times its size, while its lines are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

RATIO = 0.2
#: Nothing repeats a line that is on one page only.
LEAST_COUNT = 2
BROADCAST_BYTES = 8 << 20
SALTS = 32

#: Parts of a page without text, tags that end a line, any other tag.
NO_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK_TAGS = (r"(?i)</?(?:html|head|body|title|meta|nav|ul|ol|li|div|p|br|h[1-6]|article|section|header|footer|main"
              r"|aside|table|tr|td|th|form|hr|blockquote|pre)(?:\s[^>]*)?/?>")
ANY_TAG = r"<[^>]*>"
#: Character references that pages commonly hold, the ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def html_text(html: Column) -> Column:
    """Visible text of a page, a line per block."""
    shown = F.regexp_replace(html, NO_TEXT, "\n")
    lined = F.regexp_replace(shown, BLOCK_TAGS, "\n")
    text = F.regexp_replace(lined, ANY_TAG, "")
    for written, meant in REFERENCES:
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user or port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def lines_of(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda s: F.trim(s))


def frequent_lines(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, line, n_pages, host_pages) of boilerplate, for pages(host, text)."""
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    distinct = F.array_distinct(F.filter(lines_of(F.col("text")), lambda s: s != ""))
    counts = (pages.select("host", F.explode(distinct).alias("line"))
              .groupBy("host", "line").agg(F.count("*").alias("n_pages")))
    return (counts.filter(F.col("n_pages") >= LEAST_COUNT).join(totals, "host")
            .filter(F.col("n_pages") > F.lit(ratio) * F.col("host_pages")))


def _with_lists(pages: DataFrame, bad: DataFrame) -> DataFrame:
    """Pages with their host's list, without bringing a host's pages together."""
    size = bad.agg(F.sum(F.aggregate("bad", F.octet_length("host"), lambda n, s: n + F.octet_length(s)))).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(bad), "host", "left")
    copies = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["host", "salt"], "left").drop("salt")


def drop_frequent_lines(docs: DataFrame, host: Column, text: Column, output: str = "text",
                        ratio: float = RATIO, extra: bool = False) -> DataFrame:
    """`docs` with column `output` holding `text` without the host's boilerplate lines.

    With `extra`, also `host`, `n_lines` (not empty) and `n_removed`. Texts that lose nothing stay as
    they are to the byte; in others the remaining lines keep their own white space.
    """
    # The row travels as one struct, so its column names can't clash with those used here.
    key = F.coalesce(host, F.lit("\x00"))
    pages = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("host"),
                        text.alias("text"))
    frequent = frequent_lines(pages.select("host", "text"), ratio)
    bad = stored(frequent.groupBy("host").agg(F.collect_set("line").alias("bad")))
    found = _with_lists(pages, bad).withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    whole = F.split("text", "\n")
    kept = F.filter(whole, lambda s: ~F.array_contains(F.col("bad"), F.trim(s)))
    found = found.withColumn("_kept", kept).withColumn("_lost", F.size(whole) - F.size("_kept"))
    result = F.when(F.col("_lost") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text"))
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != output]
    at = docs.columns.index(output) if output in docs.columns else len(columns)
    columns.insert(at, result.alias(output))
    if extra:
        filled = F.filter(whole, lambda s: F.trim(s) != "")
        columns += [F.when(F.col("host") != "\x00", F.col("host")).alias("host"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size(filled)).cast("long").alias("n_lines"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.col("_lost")).cast("long").alias("n_removed")]
    return found.select(*columns)
