"""Listings: XML documents that are accepted or rejected as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import blank_cell, html_escape

LOCATION = ("StreetAddress", "City", "State", "Zip", "Lat", "Long")
DETAILS = ("Status", "Price", "ListingUrl", "Image")


def _struct(names: tuple[str, ...]) -> str:
    return "struct<" + ", ".join(f"{n}: string" for n in names) + ">"


#: Everything is text, so zip codes keep their zeros and values their blanks.
SCHEMA = f"Listing array<struct<Location: {_struct(LOCATION)}, ListingDetails: {_struct(DETAILS)}>>, _bad string"
OK, NONE, INVALID = "ok", "no listings", "invalid"

_BARE_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)"
#: One root element, then nothing but comments and white space.
_WHOLE = r"(?s)\A(?:<\?xml.*?\?>)?\s*(?:<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*<Listings(?:\s[^>]*)?(?:/>|>(?:(?!</Listings\s*>).)*</Listings\s*>)\s*(?:<!--.*?-->\s*)*\z"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, status and listings of each XML file, read whole: one malformed tag rejects the document."""
    return parse(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("xml")))


def parse(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Replaces the xml column by status (ok, no listings or invalid) and listings, in document order."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreSurroundingSpaces": "false", "nullValue": "\x00"}
    d = docs.withColumn("_x", F.from_xml(F.col(xml), SCHEMA, options))
    # The parser by itself accepts text after the root element.
    sound = F.col("_x").isNotNull() & F.col("_x._bad").isNull() & F.col(xml).rlike(_WHOLE) & ~F.col(xml).rlike(_BARE_AMPERSAND)
    listings = F.filter(F.coalesce("_x.Listing", F.array()), lambda x: x.isNotNull())
    status = F.when(~F.coalesce(sound, F.lit(False)), INVALID).when(F.coalesce(F.size("_x.Listing"), F.lit(0)) == 0, NONE).otherwise(OK)
    return d.withColumn("status", status).withColumn("listings", F.when(F.col("status") == OK, listings)).drop("_x", xml)


def flatten(docs: DataFrame) -> DataFrame:
    """One row per listing: pos and all fields, in the declared order."""
    rows = docs.select(*(c for c in docs.columns if c not in ("status", "listings")), F.posexplode("listings").alias("pos", "l"))
    keep = [c for c in rows.columns if c != "l"]
    return rows.select(*keep, "l.Location.*", "l.ListingDetails.*")


def typed(rows: DataFrame) -> DataFrame:
    """Adds latitude, longitude and amount as numbers, null where the text is none."""
    number = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return rows.withColumns({"latitude": number("Lat").try_cast("double"), "longitude": number("Long").try_cast("double"), "amount": number("Price").try_cast("decimal(12,0)")})


def _link(url: Column) -> Column:
    return F.when(blank_cell(url) == "&nbsp;", F.lit("&nbsp;")).otherwise(F.concat(F.lit('<a href="'), html_escape(url), F.lit('">link</a>')))


def _image(src: Column) -> Column:
    return F.when(blank_cell(src) == "&nbsp;", F.lit("&nbsp;")).otherwise(F.concat(F.lit('<img src="'), html_escape(src), F.lit('" alt="'), html_escape(src), F.lit('">')))


def row_html(rows: DataFrame) -> DataFrame:
    """Adds html, a table row of all cells: blank cells as non-breaking spaces, the url as a link, the image as such."""
    shown = {"ListingUrl": _link, "Image": _image}
    plain = lambda c: F.when(blank_cell(c) == "&nbsp;", F.lit("&nbsp;")).otherwise(html_escape(c))
    cells = [F.concat(F.lit("<td>"), shown.get(n, plain)(F.col(n)), F.lit("</td>")) for n in (*LOCATION, *DETAILS)]
    return rows.withColumn("html", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")))


def write_table(rows: DataFrame, path: str) -> None:
    """Writes the rows of row_html() as the lines of text files. They make up a table after HEADER and before </table>, as table() gives it."""
    rows.select("html").write.mode("overwrite").text(path)


HEADER = "<table><tr>" + "".join(f"<th>{n}</th>" for n in (*LOCATION, *DETAILS)) + "</tr>"


def table(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """keys and table: one HTML table for each document, its rows in order. A document's listings were one text before, so a table is no larger."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "html"))), lambda x: x["html"]), "")
    return row_html(rows).groupBy(*keys).agg(F.concat(F.lit(HEADER), body, F.lit("</table>")).alias("table"))
