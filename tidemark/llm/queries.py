"""The training-data operators on the driver's tables: one query each, and its SQL where SQL can tell the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codebooks, copies, lines, mixing, packing, pseudonyms, repeats, sharding, simhash, tandem, telephony, topk, toxicity
from .common import let, materialize, table, utf8


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8("text")
    n = F.length(text)
    padded = F.when(n == 0, 192).otherwise(F.ceil(n / 192) * 192).cast("int")
    # Binary has no padding function on all lengths: spaces are appended as text, which is the same bytes.
    payload = F.concat(text, F.encode(F.repeat(F.lit(" "), padded - n), "UTF-8"))
    codec = F.element_at(F.array(*map(F.lit, (telephony.MU_LAW, telephony.A_LAW, telephony.IMA_ADPCM))), (F.pmod(F.crc32(payload), F.lit(3)) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("p"), codec.alias("c"))
    files = docs.select("doc_id", "n_bytes", telephony.telephony_media(F.col("p"), F.col("c")).alias("media"))
    out = telephony.decode(files, stored=True)
    return out.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "codec", F.col("rate").cast("string"), "sound").alias("feature"), F.length("wav").cast("long").alias("wav_bytes"), F.sha2("wav", 256).alias("wav_sha256"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op3_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines.drop_shared_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = r"""
WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
spread AS (SELECT trim(line) AS line, min(doc_id) AS keeper FROM parts WHERE trim(line) <> '' GROUP BY 1
           HAVING count(DISTINCT coalesce('=' || source, '')) >= 5),
bad AS (SELECT DISTINCT doc_id, s.line FROM parts p JOIN spread s ON trim(p.line) = s.line WHERE p.doc_id <> s.keeper),
lists AS (SELECT doc_id, list(line) AS bad FROM bad GROUP BY doc_id),
cut AS (SELECT d.doc_id, string_split(text, chr(10)) AS was, list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(coalesce(bad, []), trim(x))) AS kept
        FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id)
SELECT doc_id, coalesce(len(was), 0)::INT AS n_lines, coalesce(len(was) - len(kept), 0)::INT AS n_removed, array_to_string(kept, chr(10)) AS text FROM cut
"""


def op4_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk.quantized(F.col("embedding")).alias("v"))
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_column_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = utf8("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffle_into_shards(docs, ["doc_id", "text_crc32", "size"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def held_out() -> Column:
    """Whether a document is kept out of learning."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5)) == 0


def toxic_scores(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with score; learns from the labels of documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    return toxicity.score(docs, toxicity.fit(docs.select("doc_id", "text"), labels))


def op7_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_scores(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: A key for these test tables; a user passes a secret of their own.
PSEUDONYM_KEY = "tidemark-test-key"


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymize(docs, PSEUDONYM_KEY)
    return out.select("doc_id", F.coalesce(F.size("kinds"), F.lit(0)).alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"), "text")


def op9_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), "doc_id")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS w
  FROM sized GROUP BY source),
ratio AS (SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS k FROM src),
levels AS (
  SELECT k, most / w AS own,
         (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM ratio),
level AS (SELECT lvl FROM levels WHERE lvl < own ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN most <= w * coalesce((SELECT lvl FROM level), 'Infinity'::DOUBLE) THEN most ELSE w * (SELECT lvl FROM level) END AS target FROM ratio),
ranked AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each,
         ('0x' || substr(md5('mix' || coalesce('=' || s.source, '')), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY s.source ORDER BY
           CASE WHEN size < 32 THEN size ELSE len(bin(size)) * 32 + floor(size / pow(2.0::DOUBLE, len(bin(size)) - 5)) END::INT,
           substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) AS rn
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rn * each + shift) - floor((rn - 1) * each + shift)) * size)::BIGINT AS taken FROM ranked
"""

def op11_quotient_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=("label",))
    rows = materialize(found.rows, "codes")
    errors = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    met = rows.join(errors, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after the other; squared distances are exact in doubles, as the components are small integers."""
    near = """SELECT p.n, p.part, arg_min(b.entry, (list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c))::BIGINT::HUGEINT * 65536 + b.entry) AS entry,
        min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.c) + list_inner_product(b.c, b.c))::BIGINT) AS d
      FROM p JOIN {books} b ON p.part = b.part GROUP BY p.n, p.part"""
    steps = [
        f"""v AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS n, * FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))""",
        f"p AS MATERIALIZED (SELECT n, part, w[part * (len(w) // {parts}) + 1 : (part + 1) * (len(w) // {parts})]::DOUBLE[] AS x FROM v, (SELECT unnest(range({parts})) AS part))",
        f"b0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x AS c FROM p WHERE n <= {entries})",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(books=f'b{k}')})")
        if k < rounds:
            steps.append(f"""m{k} AS MATERIALIZED (
      SELECT part, entry, list(floor(total / met) ORDER BY pos) AS c FROM (
        SELECT part, entry, pos, sum(y) AS total, count(*) AS met FROM (
          SELECT p.part, a.entry, unnest(p.x) AS y, unnest(range(len(p.x))) AS pos FROM p JOIN a{k} a ON p.n = a.n AND p.part = a.part)
        GROUP BY part, entry, pos) GROUP BY part, entry)""")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)")
    steps.append(f"""coded AS (
      SELECT n, string_agg(printf('%02x', entry::INT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n)""")
    steps.append(f"""digest AS (SELECT sha256(string_agg(y::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS h FROM (
      SELECT part, entry, unnest(c) AS y, unnest(range(len(c))) AS pos FROM b{rounds}))""")
    return "WITH " + ",\n".join(steps) + """
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT h FROM digest) AS codebooks_sha256 FROM coded JOIN v ON coded.n = v.n"""


def planted_period(doc_id: Column, text: Column) -> Column:
    """A text whose words repeat from some word on, where the id's checksum is a multiple of ten; else the text itself."""
    h = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g = F.floor(h / 10).cast("long")
    of = let(F.struct(words.alias("w")), lambda s: _repeated(s["w"], g))
    return F.when(h % 10 == 0, of).otherwise(text)


def _repeated(w: Column, g: Column) -> Column:
    n = F.size(w).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")
    at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i).cast("int"))), " ")).otherwise("")


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_period(F.col("doc_id"), F.col("text")).alias("text"))
    out = tandem.periodic_runs(docs)
    first = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("f"), F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("").alias("told"), "collapsed")
    return out.select(
        "doc_id", "n_runs", (-F.col("f.s")).alias("start"), F.col("f.length").alias("length"), (-F.col("f.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("f.length") / -F.col("f.p")).cast("long").alias("exponent_milli"), F.sha2("told", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_telephony": op1_telephony,
    "op2_configuration_packing": op2_configuration_packing,
    "op3_shared_lines": op3_shared_lines,
    "op4_branch_and_bound": op4_branch_and_bound,
    "op5_column_suffixes": op5_column_suffixes,
    "op6_hypergeometric_shards": op6_hypergeometric_shards,
    "op7_deobfuscated_toxicity": op7_deobfuscated_toxicity,
    "op8_feistel_pseudonyms": op8_feistel_pseudonyms,
    "op9_simhash_variants": op9_simhash_variants,
    "op10_systematic_mix": op10_systematic_mix,
    "op11_quotient_copies": op11_quotient_copies,
    "op12_vector_codes": op12_vector_codes,
    "op13_tandem_runs": op13_tandem_runs,
}

ORACLES = {
    "op3_shared_lines": OP3_SQL,
    "op4_branch_and_bound": OP4_SQL,
    "op10_systematic_mix": OP10_SQL,
    "op11_quotient_copies": OP11_SQL,
    "op12_vector_codes": _op12_sql(),
}
