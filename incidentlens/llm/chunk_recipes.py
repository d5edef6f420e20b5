"""Exact dedup by content-defined chunk recipes, in built-in expressions only.

A normalised text is cut where its content says so: after a pair of characters out of two fixed classes, at
the earliest `SHORTEST` and at the latest `LONGEST` characters behind the cut before. Equal texts get equal
chunks wherever they stand, and texts that differ in places share the chunks between. Chunks are
deduplicated to identifiers that are verified by their bytes; a text is then the ordered list of its
chunks' identifiers (its recipe), and two texts are equal if and only if their recipes are. A chunk's bytes
are moved once, and only once per task that holds copies of it; grouping and the join back move recipes, a
fortieth of the text or so.

Groups of any size: members are counted before they are shuffled, and the join of rows with their group
is left to adaptive skew splitting, which the settings switch on.

Defined results: a null text is an empty one, and all empty texts are one group; rows without an id take
part and lose every tie; of rows equal in text, length and id one stays (the first in the input's order);
an empty table gives no rows. A text is one value and its chunks are held together while it is cut (about
three times its size); other columns, whatever their names, are left out or, in `keep_first`, kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .identifiers import BITS, clashing, content_hash, with_identifier

#: Deleted before texts are compared.
SPACES = " \t\n\v\f\r"
SHORTEST, LONGEST = 128, 4096


def _cut_class(remainder: int) -> str:
    """Characters that a cut may follow, by a rule on code points: every eighth one up to Latin-1, one
    eighth of each block beyond. Blocks stand behind one test for their whole range."""
    def blocks(low, high, step):
        inner = "".join(rf"\x{{{c:X}}}-\x{{{c + step // 8 - 1:X}}}"
                        for c in range(low + step // 8 * remainder, high, step))
        return rf"[\x{{{low:X}}}-\x{{{high - 1:X}}}&&[{inner}]]"

    low = "".join(rf"\x{{{c:X}}}" for c in range(0x21, 0x100) if c % 8 == remainder)
    return f"[{low}{blocks(0x100, 0x800, 64)}{blocks(0x800, 0xD800, 4096)}]"


def chunk_pattern(shortest: int = SHORTEST, longest: int = LONGEST) -> str:
    """One chunk: up to the first pair of marks, or the longest allowed."""
    return rf"(?s).{{{shortest},{longest - 2}}}?{_cut_class(1)}{_cut_class(5)}|.{{1,{longest}}}"


def normalised(text):
    """`text` without its spaces; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def cut(text, shortest: int = SHORTEST, longest: int = LONGEST):
    """The chunks of a normalised text, in order."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(shortest, longest)), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
            longest: int = LONGEST, bits: int = BITS, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, points, text_sha256, recipe) of every row, as a stored table.

    `row` numbers the rows of the input or is `row_col`, `points` counts the characters of the original text; `recipe` lists
    the verified identifiers of the chunks. `bits` is the width of the hash behind them, for tests.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("_text"))
    texts = rows.withColumn("_norm", normalised(F.col("_text")))
    chunk = F.explode(cut(F.col("_norm"), shortest, longest)).alias("chunk")
    clashes = clashing(texts.select(chunk), ["chunk"], bits)
    facts = [F.coalesce(F.length("_text"), F.lit(0)).alias("points"), F.sha2("_norm", 256).alias("text_sha256")]
    if clashes is None:
        recipe = F.transform(cut(F.col("_norm"), shortest, longest), lambda c: content_hash([c], bits))
        return stored(texts.select("row", "doc_id", *facts, recipe.alias("recipe")))
    # One lineage from the numbered rows on: a row's first chunk carries what else is known of it.
    chunks = F.posexplode_outer(cut(F.col("_norm"), shortest, longest)).alias("at", "chunk")
    places = texts.select("row", "doc_id", *facts, chunks)
    first = F.when(F.coalesce("at", F.lit(0)) == 0, F.struct("doc_id", "points", "text_sha256"))
    places = places.select("row", first.alias("first"), "at", "chunk")
    ordered = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "id"))))
    return stored(with_identifier(places, ["chunk"], "id", clashes, bits).groupBy("row").agg(
        F.any_value("first", True).alias("first"), F.transform(ordered, lambda x: x["id"]).alias("recipe"))
        .select("row", "first.*", "recipe"))


def _groups(rows: DataFrame) -> DataFrame:
    """(recipe, best, group_size): per distinct text the row that stays and how many rows there are."""
    order = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
               longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id (the id of the row that stays), group_size, kept and
    text_sha256. Of equal texts the row with the most characters stays, then the smallest id."""
    rows = recipes(docs, id_col, text_col, shortest, longest, bits)
    groups = stored(_groups(rows))
    return rows.join(groups.hint("merge"), "recipe").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cuts) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    held = stored(docs.select(F.monotonically_increasing_id().alias("row"),
                              F.struct(*[docs[c] for c in docs.columns]).alias("it")))
    rows = recipes(held.select("row", *[F.col(f"it.`{c}`").alias(n) for c, n in
                                        ((id_col, "_doc"), (text_col, "_body"))]),
                   "_doc", "_body", **cuts, row_col="row")
    best = stored(_groups(rows).select(F.col("best.row").alias("row")))
    discard(rows)
    return held.join(best.hint("merge"), "row", "left_semi").select(
        *[F.col(f"it.`{c}`").alias(c) for c in docs.columns])
