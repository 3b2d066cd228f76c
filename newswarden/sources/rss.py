"""RSS 2.0 and Atom feeds with Spark's XML reader (S-05, T-17).

Items are found by their tag wherever they stand in a file, so a file may hold a feed or
many, and large files are split. Prefixes of namespaces don't matter: `content:encoded`
is `encoded`, `dc:date` is `date`.

Defined results: a file's items end before the first that is no well-formed XML, and
`broken` lists that one with its file; a file without any item has no rows and is listed by `silent` unless it is empty. A missing
field is null; a repeated one counts once, the first. Dates that can't be read are null.
An Atom entry has no guid and no categories, only a link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# Zones that RFC 822 names, and their offsets.
ZONES = (("UTC", "+0000"), ("GMT", "+0000"), ("UT", "+0000"), ("Z", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"))
# Entities that snippets may hold, besides numbers.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"), ("&amp;", "&"))
# How the names of tags begin that stand for a new line in a snippet.
_BLOCKS = "h|br|p|ul|ol|li|blockquote|section|table|tr|div"

_ITEM = "title array<string>, link array<string>, guid array<string>, description array<string>, encoded array<string>, category array<string>, pubDate array<string>, date array<string>, _broken string"
_ENTRY = "title array<string>, link array<struct<_href: string, _rel: string, _VALUE: string>>, id array<string>, content array<string>, summary array<string>, published array<string>, updated array<string>, _broken string"


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    options = {"rowTag": tag, "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "true"}
    return spark.read.format("xml").options(**options).schema(schema).load(path).select("*", F.col("_metadata.file_path").alias("file"))


def moment(c: Column) -> Column:
    """A date as feeds write it: RFC 822 with an offset or a named zone, or ISO 8601; without a zone it is the session's."""
    plain = F.regexp_replace(text.trimmed(c), r"^[A-Za-z]{3,9}\.?,?\s+(?=\d)", "")
    for name, offset in ZONES:
        plain = F.regexp_replace(plain, rf"(?<=[\d\s]){name}$", offset)
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r" ?([+-]\d\d):?(\d\d)$", " $1$2")
    dated = [F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm", "d MMM yyyy")]
    iso = F.when(F.rlike(text.trimmed(c), F.lit(r"^\d{4}-\d\d-\d\d")), F.try_to_timestamp(text.trimmed(c)))
    return F.coalesce(iso, *(F.when(F.rlike(plain, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4}")), d) for d in dated))


def snippet(c: Column) -> Column:
    """Text of a piece of HTML: block tags part lines, other tags go, entities by name and number are characters."""
    lines = F.regexp_replace(c, rf"(?s)([^\n])</?(?:{_BLOCKS}).*?>([^\n])", "$1\n$2")
    bare = F.regexp_replace(lines, r"(?s)<.*?>", "")
    number = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"&#(x[0-9a-fA-F]{1,5}|[0-9]{1,6});"), F.lit(1)))
    value = lambda n: F.when(F.startswith(n, F.lit("x")), F.conv(F.substring(n, 2, 9), 16, 10)).otherwise(n).cast("int")
    letter = lambda n: F.when(value(n).between(1, 0xD7FF) | value(n).between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(value(n)), 8, "0")), "UTF-32")).otherwise("")
    out = F.aggregate(number, bare, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), letter(n)))
    for name, plain in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(plain))
    return text.trimmed(out)


def items(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, title, link, guid, content, snippet, categories, published, iso_date) of the items and entries in the files of `path`."""
    first = lambda c: F.get(c, 0)
    none = F.array().cast("array<string>")
    whole = lambda df: df.where("_broken is null")
    rss = whole(_read(spark, path, "item", _ITEM)).select("file", F.lit("rss").alias("kind"), first("title").alias("title"), first("link").alias("link"), first("guid").alias("guid"), F.coalesce(first("description"), first("encoded")).alias("content"), F.coalesce("category", none).alias("categories"), F.coalesce(first("pubDate"), first("date")).alias("published"))
    best = F.coalesce(first(F.filter("link", lambda x: x["_rel"] == "alternate")), first("link"))
    atom = whole(_read(spark, path, "entry", _ENTRY)).select("file", F.lit("atom").alias("kind"), first("title").alias("title"), F.coalesce(best["_href"], best["_VALUE"]).alias("link"), F.lit(None).cast("string").alias("guid"), F.coalesce(first("content"), first("summary")).alias("content"), none.alias("categories"), F.coalesce(first("published"), first("updated")).alias("published"))
    both = rss.union(atom)
    return both.select("file", "kind", "title", "link", "guid", "content", snippet(F.col("content")).alias("snippet"), "categories", "published", moment(F.col("published")).alias("iso_date"))


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(file, title, record) of the files that cease to be well-formed XML, with what the reader had at that place."""
    lost = lambda tag, schema: _read(spark, path, tag, schema).select("file", F.struct(F.col("_broken").alias("record"), F.get("title", 0).alias("title")).alias("r")).where("r.record is not null")
    return lost("item", _ITEM).union(lost("entry", _ENTRY)).groupBy("file").agg(F.max("r").alias("r")).select("file", "r.title", "r.record")


def silent(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the files in which no item was found."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))
    # The reader refuses a query that needs nothing of an item but whether it is broken, so the title is looked at too.
    spoken = items(spark, path).where(F.length(F.coalesce("title", F.lit(""))) >= 0).select("file").distinct()
    return files.join(spoken, "file", "left_anti")


def normalised(found: DataFrame) -> DataFrame:
    """Items as articles: title, canonical_url, url_hash, title_hash, rss_summary, rss_categories, published_at; other columns stay.

    The address is the link or else the guid, and an item without one is left out; without a title the address is the title.
    """
    address = F.coalesce(F.nullif(text.trimmed(F.col("link")), F.lit("")), F.nullif(text.trimmed(F.col("guid")), F.lit("")))
    rows = found.withColumn("__url", address).where("__url is not null")
    title = F.coalesce(F.nullif(text.trimmed(F.col("title")), F.lit("")), F.col("__url"))
    summary = F.coalesce(F.nullif(F.col("snippet"), F.lit("")), F.col("content"))
    categories = F.array_distinct(F.filter(F.transform("categories", text.collapsed), lambda c: c != ""))
    hashed = lambda c: F.sha2(text.trimmed(c), 256)
    rows = rows.withColumns({"__title": title, "canonical_url": text.normal_url(F.col("__url")), "rss_summary": F.nullif(text.collapsed(summary), F.lit("")), "rss_categories": F.coalesce(categories, F.array().cast("array<string>")), "published_at": F.col("iso_date")})
    rows = rows.withColumns({"title": F.col("__title"), "url_hash": hashed(F.col("canonical_url")), "title_hash": hashed(text.normal_title(F.col("__title")))})
    return rows.drop("__url", "__title", "link", "guid", "content", "snippet", "categories", "published", "iso_date")
