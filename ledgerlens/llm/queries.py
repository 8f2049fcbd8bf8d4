"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, jaccard, langid, licenses, merkle, pieces, pii, sharding, tokencount, urlrules, warc, whitening
from .common import scratch, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")

#: The rules of the URL query (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def query(name: str, sql: str | None = None):
    def register(function):
        LLM_QUERIES[name] = function
        if sql:
            LLM_SQL[name] = sql
        return function

    return register


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of known licenses in all documents, near copies of the wording included."""
    rows = [(k, license_, text) for k, (license_, text) in enumerate(licenses.NOTICES)]
    templates = spark.createDataFrame(rows, "template_id int, license string, text string")
    return licenses.license_matches(table(spark, folder, "documents"), templates, {"doc_id": "doc_id"})


@query("op2_sharding")
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of all documents; row counts at most one apart."""
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = sharding.assign_shards(slim, ["doc_id", "size", "text_crc32"], 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@query("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pieces.encode_digests(docs, PIECE_MODEL, {"doc_id": "doc_id"})


@query(
    "op4_decontamination",
    r"""WITH docs AS (
      SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    items AS (
      SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_starts AS (
      SELECT item_id, w, least(len(w), 10) AS n,
        unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM item_starts),
    sizes AS (SELECT DISTINCT n FROM windows),
    doc_starts AS (
      SELECT d, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n),
    hits AS (
      SELECT d, i, s.n, item_id FROM doc_starts s JOIN windows v
        ON s.n = v.n AND array_to_string(w[i:i + s.n - 1], ' ') = gram),
    covered AS (
      SELECT d, count(DISTINCT p) AS n_hit
      FROM (SELECT d, unnest(range(i, i + n)) AS p FROM hits) GROUP BY d),
    found AS (
      SELECT d, count(*) AS n_items,
        string_agg(item, ',' ORDER BY item) AS list
      FROM (SELECT DISTINCT d, item_id::VARCHAR AS item FROM hits) GROUP BY d)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
      coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (d) LEFT JOIN found USING (d)""",
)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"), {"doc_id": "doc_id"})


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


@query("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles from two thirds of the labelled documents, applied to all."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~held_out()))
    judged = langid.identify(docs, profiles, {"doc_id": "doc_id"})
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return tokencount.token_counts(docs, BYTE_FILE, 1024, {"doc_id": "doc_id"})


@query(
    "op9_jaccard_join",
    """WITH RECURSIVE docs AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    starts AS (
      SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0),
    grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM starts),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (
      SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
      FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (
      SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
      WHERE 100 * k >= 85 * (x.n + y.n - k)),
    reach AS (
      SELECT doc_id AS node, doc_id AS r FROM docs
      UNION SELECT links.b, reach.r FROM reach JOIN links ON links.a = reach.node),
    best AS (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
    FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN best ON best.node = doc_id""",
)
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, folder, "documents"))


@query("op8_nearest_vectors")
def op8_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 50."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"))


URL_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


@query(
    "op10_url_rules",
    f"""WITH parts AS (
      SELECT page_id, row_number() OVER () AS n,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
      FROM pages),
    rules(rule_host, rule_path, rule_verdict) AS (VALUES {URL_RULES_SQL}),
    fits AS (
      SELECT n, rule_host || rule_path AS rule, rule_verdict,
        row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS k
      FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
        AND starts_with(path, rule_path))
    SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
    FROM parts LEFT JOIN fits ON parts.n = fits.n AND k = 1""",
)
def op10_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge_urls(table(spark, folder, "pages"), rules, "page_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened values of all usable vectors along the four components of most variance."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    spaces = whitening.fit(vectors, components=4)
    white = whitening.whiten(vectors, spaces, {"vec_id": "vec_id"})
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return white.select("vec_id", "n", "deviation", "identity_error", pairs).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation",
        "pair.whitened", "pair.explained", "identity_error",
    )


CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(1, length(d) + 1), lambda k: ascii(d[k])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)),
      lambda t, k: xor(t >> 1, (t & 1) * 3988292384))), 4294967295)"""


def leaf_sql(text: str) -> str:
    """Leaf of a document in SQL, with another expression for its text."""
    shown = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({s}) || ':' || {s}, '-')" for s in shown) + ")"


@query(
    "op12_merkle_manifest",
    f"""WITH RECURSIVE docs AS (
      SELECT *, row_number() OVER () AS r, doc_id::VARCHAR AS d FROM documents),
    leaves AS (
      SELECT r, doc_id, source, {leaf_sql("text")} AS leaf,
        {leaf_sql("replace(text, chr(10), '')")} AS cut,
        coalesce({CRC_SQL} % 2 = 0, false) AS odd
      FROM docs),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i,
        count(*) OVER (PARTITION BY source) AS n FROM leaves),
    up AS (
      SELECT source, 0 AS lvl, i, n, leaf AS h FROM placed
      UNION ALL SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
      FROM up WHERE n > 1 GROUP BY source, lvl, i // 3, n),
    subroots AS (
      SELECT source, lvl, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
      FROM up WHERE n = 1),
    over AS (
      SELECT 0 AS lvl, i, n, h FROM subroots
      UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
      FROM over WHERE n > 1 GROUP BY lvl, i // 3, n),
    groups AS (
      SELECT u.source, 0 AS part, u.lvl, u.i // 3 AS run, u.n, list(u.h ORDER BY u.i) AS hs
      FROM up u GROUP BY u.source, u.lvl, u.i // 3, u.n
      UNION ALL SELECT NULL, 1, lvl, i // 3, n, list(h ORDER BY i) FROM over GROUP BY lvl, i // 3, n),
    walk AS (
      SELECT p.r, p.source, s.i AS top, 0 AS part, 0 AS lvl, p.i, p.n,
        CASE WHEN odd THEN cut ELSE leaf END AS h, '' AS proof
      FROM placed p JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
      UNION ALL
      SELECT w.r, w.source, w.top,
        CASE WHEN w.n = 1 THEN 1 ELSE w.part END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END,
        CASE WHEN w.n = 1 THEN w.top ELSE w.i // 3 END,
        CASE WHEN w.n = 1 THEN (SELECT count(*) FROM subroots) ELSE (w.n + 2) // 3 END,
        CASE WHEN w.n = 1 THEN w.h ELSE sha256(array_to_string(hs[:(w.i % 3)::INT], '') || w.h
          || array_to_string(hs[(w.i % 3 + 2)::INT:], '')) END,
        CASE WHEN w.n = 1 THEN w.proof ELSE w.proof || array_to_string(hs[:(w.i % 3)::INT], '')
          || array_to_string(hs[(w.i % 3 + 2)::INT:], '') END
      FROM walk w JOIN groups g ON w.part = g.part AND w.lvl = g.lvl AND w.i // 3 = g.run
        AND (w.part = 1 OR w.source IS NOT DISTINCT FROM g.source)
      WHERE w.part = 0 OR w.n > 1)
    SELECT p.doc_id, p.leaf, s.h AS subroot, o.h AS root, sha256(w.proof) AS proof_sha256,
      w.h AS folded_root, w.h = o.h AS verified
    FROM placed p JOIN walk w ON p.r = w.r AND w.part = 1 AND w.n = 1
      JOIN subroots s ON p.source IS NOT DISTINCT FROM s.source
      JOIN over o ON o.n = 1""",
)
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, subroots and proofs of all documents; half of them tampered with and checked."""
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    cut = merkle.leaf([F.col(c) for c in fields[:-1]] + [text])
    made = merkle.build(docs, fields, "doc_id", "source", scratch(spark, "manifest"), {"cut": cut})
    root = F.lit(made.root).cast("string")
    fold = merkle.folded(F.col("cut"), F.col("path"))
    return made.rows.select(
        "doc_id", merkle.text_of(F.col("leaf")).alias("leaf"),
        merkle.text_of(F.col("subroot")).alias("subroot"), root.alias("root"),
        merkle.proof(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query(
    "op13_warc_archives",
    """WITH sized AS (
      SELECT page_id, row_number() OVER () AS r, strlen(coalesce(html, '')) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r) AS k,
        first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r) AS origin
      FROM sized)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
      CASE WHEN k > 1 AND payload_bytes >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN k > 1 AND payload_bytes >= 100 THEN origin END AS refers_to
    FROM ranked""",
)
def op13_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to WARC archives, repeated payloads as revisits, and read back."""
    pages = table(spark, folder, "pages")
    path = f"{scratch(spark, 'warc')}/archives"
    warc.write(pages, path, "page_id", "url", "html")
    whole = pages.schema["page_id"].dataType
    read = warc.resolved(warc.read(spark, path))
    return read.select(
        F.col("source_id").cast(whole).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").cast(whole).alias("refers_to"),
    )
