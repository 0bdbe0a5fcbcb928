"""Gridded forecast coverage documents (XML multipoint coverage) -> one row per point and time.

A document is cut into its members first; Spark's built-in XPath functions pull the position list,
the value tuples and the field names out of each, and the text lists are split, zipped and exploded
with Column expressions. Files are read member by member, so a large file is many tasks; no Python
runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions import utc_string
from footfall.operators.places import numbered_rows

# --- fixed values: element names of the coverage document ---------------------------------------
POSITIONS_XPATH = '/descendant::*[local-name()="positions"]'
VALUES_XPATH = '/descendant::*[local-name()="doubleOrNilReasonTupleList"]'
LISTS_XPATH = f'concat(string({POSITIONS_XPATH}), "|", string({VALUES_XPATH}))'   # lists of numbers hold no bar
FIELD_NAMES_XPATH = '/descendant::*[local-name()="field"]/@name'
NAMES_AT_ONCE = 4         # field names that come with the lists (an XPath has 100 operators at most); a member with more takes a call for them
NO_XML = "\u0001"         # a character that no XML document holds
MEMBER_XPATH = "concat(" + f', "{NO_XML}", '.join(
    [LISTS_XPATH, f"count({FIELD_NAMES_XPATH})", *(f"string(({FIELD_NAMES_XPATH})[{k}])" for k in range(1, NAMES_AT_ONCE + 1))]) + ")"
POSITION_KEYS = ["x", "y", "timestamp"]
MEMBER_PATTERN = r"(?s)<(?:\w+:)?member[\s>].*?</(?:\w+:)?member\s*>"
MEMBER_END = "</wfs:member>"
# --------------------------------------------------------------------------------------------------


def _rows_of_numbers(text: Column) -> Column:
    """'a b c\\n d e f' -> [[a, b, c], [d, e, f]] as doubles (lines trimmed, split on whitespace)."""
    def strip(c):
        return F.regexp_replace(c, r"^\s+|\s+$", "")

    lines = F.filter(F.split(strip(text), "\n"), lambda ln: strip(ln) != "")   # blank lines carry no tuple
    return F.transform(lines, lambda ln: F.transform(F.split(strip(ln), r"\s+"),
                                                     lambda v: v.try_cast("double")))


def parse_coverage(docs: DataFrame, field_names: Sequence[str], xml_col: str = "xml",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Documents -> (keep..., member, point, x, y, time, one column per name in ``field_names``).

    Each member of a document is parsed by itself, with its own field names; a document without
    member elements is one member. Positions and value tuples are paired by position and the pairing stops at the shorter list;
    inside a tuple, names and values pair up the same way. The output columns come from the
    explicit ``field_names`` list (a data-dependent pivot would need an extra pass).
    """
    found = F.regexp_extract_all(F.col(xml_col), F.lit(MEMBER_PATTERN), F.lit(0))
    members = docs.select(*keep, F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.array(F.col(xml_col)))).alias("member", "_xml"))
    return parse_members(members, field_names, "_xml", keep)


def parse_members(members: DataFrame, field_names: Sequence[str], xml_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One member's XML per row (with its number in ``member``) -> rows of points."""
    keep = [*keep, "member"]
    x = F.col(xml_col)
    # every XPath call parses the member again: both lists, the number of names and the first of them come from one call
    own = [*[F.col(k) for k in keep[:-1]], F.col("member").cast("bigint").alias("member")]
    found = members.select(*own, x.alias("_member_xml"), F.split(F.xpath_string(x, F.lit(MEMBER_XPATH)), NO_XML).alias("_found"))
    count = F.col("_found")[1].cast("int")
    names = F.when(count > NAMES_AT_ONCE, F.xpath("_member_xml", F.lit(FIELD_NAMES_XPATH))).otherwise(F.slice("_found", F.lit(3), count))
    lists = found.select(*keep, F.split(F.col("_found")[0], r"\|", 2).alias("_lists"), names.alias("_names"))
    parsed = lists.select(*keep, _rows_of_numbers(F.col("_lists")[0]).alias("_pos"), _rows_of_numbers(F.col("_lists")[1]).alias("_val"), "_names")
    n = F.least(F.size("_pos"), F.size("_val"))
    zipped = parsed.select(*keep, "_names",
                           F.posexplode(F.arrays_zip(F.slice("_pos", 1, n), F.slice("_val", 1, n))).alias("_i", "_pv"))
    # arrays_zip names the struct fields after the input expressions; take them by position
    pairs = zipped
    p = F.col("_pv")
    fields = pairs.schema["_pv"].dataType.fieldNames()
    pos_arr, val_arr = p.getField(fields[0]), p.getField(fields[1])
    m = F.least(F.size("_names"), F.size(val_arr))
    values = F.map_from_arrays(F.slice("_names", 1, m), F.slice(val_arr, 1, m))
    out = pairs.select(
        *keep, F.col("_i").cast("bigint").alias("point"),
        F.try_element_at(pos_arr, F.lit(1)).alias("x"), F.try_element_at(pos_arr, F.lit(2)).alias("y"),
        utc_string(F.try_element_at(pos_arr, F.lit(3))).alias("time"),
        values.alias("_values"))
    return out.select(*keep, "point", "x", "y", "time",
                      *[F.try_element_at("_values", F.lit(nm)).alias(nm) for nm in field_names])


def coverage_parts(spark: SparkSession, path: str) -> DataFrame:
    """The members of coverage files as the reader cuts them: (source, _block, _part, _at, _xml). ``_at``
    grows by one from a member to the next inside a task."""
    parts = spark.read.text(path, lineSep=MEMBER_END).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"),
        F.regexp_extract("value", r"(?s)<wfs:member[\s>].*", 0).alias("_xml"))
    return numbered_rows(parts.where(F.col("_xml") != "").withColumn("_xml", F.concat("_xml", F.lit(MEMBER_END))))


def member_offsets(parts: DataFrame) -> DataFrame:
    """(source, _block, _shift): what a member's ``_at`` is short of, or beyond, its rank in its file.

    Members are counted per input block, and a block's offset is the sum of the counts of the blocks
    before it in its file: the window sees one row a block, never the XML. The count names the XML, so that
    it reads the shuffle that the join reads."""
    blocks = parts.groupBy("source", "_block").agg(F.count("_xml").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return blocks.select("source", "_block", (offset - F.col("_first")).alias("_shift"))


def read_coverage(spark: SparkSession, path: str, field_names: Sequence[str]) -> DataFrame:
    """Coverage files, read member by member: the reader splits a file at the ends of its members,
    so no file has to fit one row and one large file is many tasks. ``member`` is the rank of a member in
    its file; the tasks number their members themselves. One shuffle of the members by their blocks serves
    the counts and the join with them, so each file is opened once."""
    parts = coverage_parts(spark, path).repartition("source", "_block")
    numbered = parts.join(member_offsets(parts), ["source", "_block"]).withColumn("member", F.col("_at") + F.col("_shift"))
    return parse_members(numbered, field_names, "_xml", keep=["source"])
