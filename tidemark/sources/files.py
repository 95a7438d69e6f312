"""Record files: scans with schemas, guarded parsing, ledgers, incremental loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An event record; fields that files leave out are null.
EVENT = (
    "slug string, name string, namePt string, nameEn string, date string, endDate string, venue string, venueSlug string, category string, price string, "
    "priceFrom double, currency string, description string, descriptionPt string, longDescription string, longDescriptionPt string, sourceEdition string, "
    "addedAt string, lastSeenAt string, externalLink string, pickCandidate boolean, editorPickRank int, gomryId string, feverId string, "
    "image struct<url string, credit string, sourceUrl string>"
)
#: A listing from a source.
CANDIDATE = (
    "source string, sourceId string, name string, date string, endDate string, venue string, address string, postalCode string, city string, url string, "
    "price string, priceFrom double, tags array<string>, sessions array<string>, pageText string, recurring boolean"
)
#: A lead to follow up.
LEAD = (
    "name string, date string, endDate string, venue string, url string, note string, source string, addedAt string, status string, attempts int, "
    "lastTriedAt string, reason string, eventSlug string, resolvedAt string"
)
CATALOG = "id string, name string, url string, venue string, sessions array<string>, price double, currency string, tier int, commissionable boolean, subCategory string"


def records(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """One JSON record per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def wrapped(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """The rows of one array field of a JSON file."""
    return spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.inline(field))


def with_body_files(posts: DataFrame, folder: str, slug: str, pattern: str) -> DataFrame:
    """The posts of an index that have a body file under a folder (S06); ``pattern`` finds the slug in a file's path. No body is read."""
    names = posts.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_extract("path", pattern, 1).alias(slug))
    return posts.join(names.distinct(), slug, "left_semi")


def json_slice(text: Column) -> Column:
    """From the first opening brace to the last closing one; null without both."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def parsed_or_null(text: Column, schema: str, required: str) -> Column:
    """A JSON text by schema; null where it isn't one whole object or lacks the required field."""
    # As the one element of a list, since an object by itself counts as whole whatever follows it.
    got = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    return F.when((F.size(got) == 1) & F.get(got, F.lit(0))[required].isNotNull(), F.get(got, F.lit(0)))


def ledger(df: DataFrame, text: str) -> DataFrame:
    """(week, step, at) of {week: {step: at}} texts; a malformed text fails the job."""
    weeks = F.from_json(F.col(text), "map<string, map<string, string>>", {"mode": "FAILFAST"})
    steps = df.select(F.explode(weeks).alias("week", "steps"))
    return steps.select("week", F.explode("steps").alias("step", "at"))


def csv_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV log with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def blob_id(content: Column) -> Column:
    """The content id of a file: SHA-1 over "blob <length>", a zero byte and the bytes."""
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.char(F.lit(0))), "UTF-8")
    return F.sha1(F.concat(head, content))


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, content) of all files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", blob_id(F.col("content")).alias("id"), "content")


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content isn't known (S03): the rest is reused."""
    return now.join(known.select("path", "id"), ["path", "id"], "left_anti")


def recent(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the last days."""
    return df.filter(F.col(at) > now - F.make_dt_interval(days=F.lit(days)))


def members(*lists: DataFrame, address: Column) -> DataFrame:
    """Active members of several lists, each address once, the first list first."""
    from ..operators.merging import one_per

    both = None
    for k, one in enumerate(lists):
        one = one.filter("NOT unsubscribed").withColumns({"_list": F.lit(k), "_address": address})
        both = one if both is None else both.unionByName(one)
    return one_per(both, ["_address"], ["_list"]).drop("_list", "_address")
