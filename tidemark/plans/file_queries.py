"""Record files in their own shapes: the tables are written as the files that a site keeps, and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import merging
from ..sources import files
from .queries import query
from .storage import shared_dir, table


def _place(spark) -> str:
    return f"{shared_dir(spark)}/tidemark/files-{uuid.uuid4().hex}"


def _wrapped(rows, field: str, part, path: str) -> None:
    """One JSON file {field: [rows]} for each value of ``part``, which bounds a file's rows."""
    one = rows.groupBy(part.alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias(field))).alias("value"))
    one.repartition("part").write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)


@query("""WITH w AS (SELECT DISTINCT date_trunc('week', o_orderdate)::DATE AS d FROM orders)
SELECT strftime(d, '%Y-%m-%d') AS slug, 'Week of ' || strftime(d, '%-d %b %Y') AS title, CASE WHEN day(d) % 2 = 0 THEN 'Semana de ' || strftime(d, '%d/%m') ELSE 'Week of ' || strftime(d, '%-d %b %Y') END AS title_pt, day(d) % 2 = 0 AS in_pt FROM w""")
def edition_indexes(spark, d):
    """Indexes of editions in two languages, a file a year; Portuguese titles where that index has the edition."""
    w = table(spark, d, "orders").select(F.to_date(F.date_trunc("week", "o_orderdate")).alias("d")).distinct()
    rows = w.select(F.date_format("d", "yyyy-MM-dd").alias("slug"), F.concat(F.lit("Week of "), F.date_format("d", "d MMM yyyy")).alias("title"))
    pt = w.filter(F.dayofmonth("d") % 2 == 0).select(F.date_format("d", "yyyy-MM-dd").alias("slug"), F.concat(F.lit("Semana de "), F.date_format("d", "dd/MM")).alias("title"))
    at = _place(spark)
    for lang, index in (("en", rows), ("pt", pt)):
        _wrapped(index, "newsletters", F.left("slug", F.lit(4)), f"{at}/{lang}")
    en, other = (files.wrapped(spark, f"{at}/{x}", "newsletters", "slug string, title string") for x in ("en", "pt"))
    met = en.join(other.withColumnRenamed("title", "_pt"), "slug", "left")
    return met.select("slug", "title", F.coalesce("_pt", "title").alias("title_pt"), F.col("_pt").isNotNull().alias("in_pt"))


@query("""SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, p_brand AS title FROM part WHERE right(p_brand, 1)::INT % 2 = 0""")
def posts_with_bodies(spark, d):
    """Posts of an index that have a body file in the other language."""
    posts = table(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"), F.col("p_brand").alias("title")).distinct()
    at = _place(spark)
    _wrapped(posts, "posts", F.right("slug", F.lit(1)), f"{at}/index")
    bodies = posts.filter(F.right("slug", F.lit(1)).cast("int") % 2 == 0)
    bodies.select("slug", F.concat(F.lit("<p>"), "title", F.lit("</p>")).alias("value")).repartition("slug").write.partitionBy("slug").text(f"{at}/pt")
    index = files.wrapped(spark, f"{at}/index", "posts", "slug string, title string")
    return files.with_body_files(index, f"{at}/pt", "slug", r"slug=([^/]+)/")


@query("""SELECT 'first' AS catalog, p_partkey::VARCHAR AS id, p_name AS name, p_brand AS venue FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'second', p_partkey::VARCHAR, p_name, p_brand FROM part WHERE p_partkey % 3 = 0 AND p_size > 10 AND p_brand NOT IN (SELECT p_brand FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 1)""")
def catalog_scans(spark, d):
    """Two catalogs, each in files of at most a thousand items; the second without excluded venues."""
    p, at = table(spark, d, "part"), _place(spark)
    items = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("venue"), "p_size", "p_partkey")
    bucket = F.floor(F.col("id").cast("long") / 1000).cast("string")
    _wrapped(items.filter("p_partkey % 2 = 0").select("id", "name", "venue"), "items", bucket, f"{at}/first")
    _wrapped(items.filter("p_partkey % 3 = 0").select("id", "name", "venue", F.col("p_size").alias("size")), "items", bucket, f"{at}/second")
    venues = p.groupBy(F.col("p_brand").alias("venue")).agg(F.min("p_partkey").alias("k")).filter("k % 2 = 1").select("venue")
    venues.select(F.to_json(F.struct("venue")).alias("value")).write.text(f"{at}/excluded")
    excluded = spark.read.schema("venue string").json(f"{at}/excluded")
    kind = "id string, name string, venue string"
    first = files.wrapped(spark, f"{at}/first", "items", kind)
    second = files.wrapped(spark, f"{at}/second", "items", f"{kind}, size int").filter("size > 10").join(excluded, "venue", "left_anti")
    return first.select(F.lit("first").alias("catalog"), "id", "name", "venue").unionByName(second.select(F.lit("second").alias("catalog"), "id", "name", "venue"))


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS week, o_orderstatus AS step, o_custkey FROM orders)
SELECT DISTINCT week, step FROM o EXCEPT SELECT week, step FROM o WHERE o_custkey % 50 = 0""")
def ledger_claims(spark, d):
    """Steps that no ledger has yet; ledgers are texts {week: {step: at}}, a customer each, and a malformed one fails the job."""
    o = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("week"), F.col("o_orderstatus").alias("step"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    steps = o.filter("o_custkey % 50 = 0").groupBy("o_custkey", "week", "step").agg(F.max("at").alias("at"))
    weeks = steps.groupBy("o_custkey", "week").agg(F.map_from_entries(F.collect_list(F.struct("step", "at"))).alias("steps"))
    at = _place(spark)
    weeks.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("week", "steps")))).alias("value")).select("value").write.text(at)
    return merging.claim(files.ledger(spark.read.text(at), "value"), o.select("week", "step").distinct()).select("week", "step")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 7 > 0 THEN lang END AS lang FROM documents""")
def sliced_replies(spark, d):
    """A JSON object inside a reply of other words, from its first brace to its last; null where it isn't one."""
    docs = table(spark, d, "documents")
    whole = F.to_json(F.struct("doc_id", "n_chars", "lang"))
    said = F.concat(F.lit("Here it is:\n```json\n"), F.when(F.col("doc_id") % 7 == 0, F.concat(whole, F.lit(" and {broken}"))).otherwise(whole), F.lit("\n``` Done."))
    got = files.parsed_or_null(files.json_slice(said), "doc_id bigint, n_chars bigint, lang string", "doc_id")
    return docs.select("doc_id", got.alias("r")).select("doc_id", "r.n_chars", "r.lang")


@query("""SELECT o_orderdate::DATE AS day, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def daily_csv_log(spark, d):
    """A daily log kept as CSV with a header, a file a month, read by its schema."""
    o = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
    at = _place(spark)
    o.withColumn("month", F.date_format("day", "yyyy-MM")).repartition("month").write.partitionBy("month").option("header", True).csv(at)
    return files.csv_log(spark, f"{at}/*", "day date, n long, most double")


@query("""SELECT lower(n_name) AS slug, n_name AS name, strftime(DATE '2026-01-01' + n_nationkey::INT, '%Y-%m-%d') AS date FROM nation WHERE n_nationkey <> 7""")
def record_files(spark, d):
    """A folder of records, one JSON file each, newest first; a point lookup of one of them is left out."""
    n, at = table(spark, d, "nation"), _place(spark)
    rows = n.select(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), F.col("n_nationkey").cast("int")), "yyyy-MM-dd").alias("date"))
    rows.write.option("maxRecordsPerFile", 1).json(at)
    got = files.records(spark, at)
    one = got.filter(F.col("date") == "2026-01-08").select("slug")
    return got.join(one, "slug", "left_anti").orderBy(F.desc("date")).select("slug", "name", "date")
