"""Queries: text consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text
from . import frames
from .registry import query

# Rules over part names: type of the part → words that would confirm it.
PART_RULES = [
    ("ECONOMY", ["widget", "bolt"]),
    ("SMALL", ["ring", "gear"]),
    ("PROMO", ["gizmo", "anvil"]),
]
# Many rules, as a trade keyword table has: 64 labels with six phrases each.
_COLOURS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
_THINGS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
MANY_RULES = [
    (
        ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"][(5 * i + j) % 6]
        if (i + j) % 3 == 0 else f"TRADE {i}{j}",
        [f"{_COLOURS[i]} {_THINGS[(j + k) % 8]}" for k in (0, 3)]
        + [f"{colour}-{_THINGS[j]}" for colour in ("grey", "pink", "white", "black")],
    )
    for i in range(8)
    for j in range(8)
]


def supplier_types(spark, folder):
    items = frames.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    part = frames.table(spark, folder, "part").select("p_partkey", "p_type")
    joined = items.join(part, items.l_partkey == part.p_partkey)
    pairs = joined.withColumnRenamed("l_suppkey", "supplier_id")
    return text.association_stats(pairs, "supplier_id", "p_type", max_share=0.15)


STATS_SQL = """pairs AS (
  SELECT l_suppkey AS supplier_id, p_type, count(*) AS pair_count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
stats AS (
  SELECT *, CAST(sum(pair_count) OVER (PARTITION BY supplier_id) AS BIGINT) AS total_count,
    count(*) OVER (PARTITION BY supplier_id) AS trade_count FROM pairs),
rated AS (
  SELECT *, CAST(pair_count AS DOUBLE) / total_count AS ratio,
    trade_count > 1 AND CAST(pair_count AS DOUBLE) / total_count < 0.15 AS is_outlier
  FROM stats)"""


@query("t1_association_stats", f"WITH {STATS_SQL} SELECT * FROM rated")
def association_stats(spark, folder):
    return supplier_types(spark, folder)


def _verdict_sql(name: str, trade: str, rules=PART_RULES) -> str:
    hits = [
        (label, "(" + " OR ".join(f"contains(lower({name}), '{w}')" for w in words) + ")")
        for label, words in rules
    ]
    own = " OR ".join(f"({hit} AND {trade} = '{label}')" for label, hit in hits)
    conflicts = " ".join(
        f"WHEN {hit} AND {trade} IS DISTINCT FROM '{label}' THEN 'CONFLICT_WITH_{label}'"
        for label, hit in hits
    )
    return f"CASE WHEN {own} THEN 'CONFIRMED_BY_NAME' {conflicts} ELSE 'NO_KEYWORD_INFO' END"


_NAMED_SQL = f"""names AS (
  SELECT s_name || ' ' || p_name AS company, p_type FROM lineitem
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
pairs AS (SELECT company, p_type, count(*) AS pair_count FROM names GROUP BY 1, 2),
stats AS (
  SELECT *, CAST(sum(pair_count) OVER (PARTITION BY company) AS BIGINT) AS total_count,
    count(*) OVER (PARTITION BY company) AS trade_count FROM pairs),
rated AS (
  SELECT *, CAST(pair_count AS DOUBLE) / total_count AS ratio FROM stats),
outliers AS (
  SELECT *, true AS is_outlier, {_verdict_sql('company', 'p_type')} AS check_result
  FROM rated WHERE trade_count > 1 AND ratio < 0.2)"""


def named_outliers(spark, folder):
    """Outliers of supplier-and-part names against part types."""
    items = frames.table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    part = frames.table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    supplier = frames.table(spark, folder, "supplier").select("s_suppkey", "s_name")
    names = (
        items.join(part, items.l_partkey == part.p_partkey)
        .join(supplier, items.l_suppkey == supplier.s_suppkey)
        .select(F.concat_ws(" ", "s_name", "p_name").alias("company"), "p_type")
    )
    stats = text.association_stats(names, "company", "p_type")
    return text.association_outliers(stats, "company", "p_type", PART_RULES)


@query("t2_outlier_filter", f"WITH {_NAMED_SQL} SELECT * FROM outliers")
def outlier_filter(spark, folder):
    return named_outliers(spark, folder)


@query(
    "t3_keyword_classification",
    f"""SELECT p_partkey, p_name, p_type, {_verdict_sql('p_name', 'p_type')} AS check_result
    FROM part""",
)
def keyword_classification(spark, folder):
    part = frames.table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return text.with_keyword_verdict(part, "p_name", "p_type", PART_RULES)


@query(
    "t3_keyword_classification_many_rules",
    f"""SELECT p_partkey, p_name, p_type, {_verdict_sql('p_name', 'p_type', MANY_RULES)}
      AS check_result
    FROM part""",
)
def keyword_classification_many_rules(spark, folder):
    part = frames.table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return text.with_keyword_verdict(part, "p_name", "p_type", MANY_RULES)


@query(
    "t3_keyword_rule_table",
    """WITH named AS (
      SELECT p_partkey, p_brand || ' ' || p_name AS company, p_type FROM part),
    rules AS (
      SELECT lower(company) AS word, min(p_partkey) AS priority, arg_min(p_type, p_partkey) AS label
      FROM named GROUP BY 1),
    hits AS (
      SELECT company, label, min(priority) AS priority
      FROM (SELECT DISTINCT company FROM named) JOIN rules ON contains(lower(company), word)
      GROUP BY 1, 2),
    verdicts AS (
      SELECT n.company, n.p_type, bool_or(label = n.p_type) AS own,
        arg_min(label, priority) FILTER (label IS DISTINCT FROM n.p_type) AS other
      FROM (SELECT DISTINCT company, p_type FROM named) n LEFT JOIN hits USING (company) GROUP BY 1, 2)
    SELECT p_partkey, n.company, n.p_type, CASE WHEN own THEN 'CONFIRMED_BY_NAME'
      WHEN other IS NOT NULL THEN 'CONFLICT_WITH_' || upper(other) ELSE 'NO_KEYWORD_INFO' END AS check_result
    FROM named n JOIN verdicts v ON n.company = v.company AND n.p_type IS NOT DISTINCT FROM v.p_type""",
)
def keyword_rule_table(spark, folder):
    """Rules as a table that grows with the data: each brand and name stands for its first part's type."""
    company = F.concat_ws(" ", "p_brand", "p_name").alias("company")
    part = frames.table(spark, folder, "part").select("p_partkey", company, "p_type")
    first = part.groupBy("company").agg(F.min("p_partkey").alias("priority"), F.min_by("p_type", "p_partkey").alias("label"))
    rules = first.select("priority", "label", F.array("company").alias("keywords"))
    return text.with_keyword_verdict(part, "company", "p_type", rules)


NEIGHBOUR_SQL = """neighbours AS (
  SELECT a.vec_id AS company, b.vec_id AS trade, list_cosine_similarity(
      CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def neighbour_mismatches(spark, folder):
    """Each vector against its successor, as stand-in for two name columns."""
    vectors = frames.table(spark, folder, "embeddings")
    side = vectors.select(F.col("vec_id").alias("value"), F.col("embedding").alias("vector"))
    rows = vectors.select(
        F.col("vec_id").alias("company"), (F.col("vec_id") + 1).alias("trade")
    )
    return text.semantic_mismatches(rows, "company", "trade", side, side)


@query(
    "t4_semantic_mismatch",
    f"""WITH {NEIGHBOUR_SQL} SELECT company, trade, round(similarity, 9) AS similarity
    FROM neighbours WHERE similarity < 0.2""",
)
def semantic_mismatch(spark, folder):
    return neighbour_mismatches(spark, folder).withColumn("similarity", F.round("similarity", 9))


def part_name_mismatches(spark, folder):
    """Part names against part types, with the built-in 3-gram encoder."""
    part = frames.table(spark, folder, "part").select("p_partkey", "p_name", "p_type")
    return text.sparse_mismatches(
        part,
        "p_name",
        "p_type",
        text.ngram_weights(part, "p_name"),
        text.ngram_weights(part, "p_type"),
    )


def _vectors_sql(name: str, column: str) -> str:
    """CTEs: distinct values of a part column with their 3-gram vectors."""
    return f"""{name}_buckets AS (
  SELECT value, list_transform(range(1, length(value) + 2), lambda i:
      ('0x' || substr(md5(substr('  ' || lower(value) || ' ', i, 3)), 1, 8))::BIGINT % 64) AS b
  FROM (SELECT DISTINCT {column} AS value FROM part WHERE {column} IS NOT NULL)),
{name}_counts AS (
  SELECT value, list_transform(range(0, 64), lambda k:
      len(list_filter(b, lambda x: x = k))::DOUBLE) AS n FROM {name}_buckets),
{name} AS (
  SELECT value, list_transform(n, lambda x: x / sqrt(list_dot_product(n, n))) AS vector
  FROM {name}_counts)"""


@query(
    "t4_semantic_mismatch_encoded",
    f"""WITH {_vectors_sql("names", "p_name")}, {_vectors_sql("types", "p_type")},
    scored AS (
      SELECT p_partkey, p_name, p_type, list_cosine_similarity(a.vector, b.vector) AS similarity
      FROM part JOIN names a ON a.value = p_name JOIN types b ON b.value = p_type)
    SELECT p_partkey, p_name, p_type, round(similarity, 9) AS similarity FROM scored
    WHERE similarity < 0.2""",
)
def semantic_mismatch_encoded(spark, folder):
    found = part_name_mismatches(spark, folder)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(
    "t5_distinct_value_encode",
    f"""WITH {_vectors_sql("names", "p_name")}
    SELECT value, list_transform(vector, lambda x: round(x, 9)) AS vector FROM names""",
)
def distinct_value_encode(spark, folder):
    vectors = text.ngram_vectors(frames.table(spark, folder, "part"), "p_name")
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.round(x, 9)))


@query(
    "t6_percent_formatting",
    f"""WITH {_NAMED_SQL} SELECT company, p_type AS "trade (order)", pair_count AS orders,
      format('{{:.2f}}%', ratio * 100) AS "share of volume", check_result AS "name check"
    FROM outliers""",
)
def percent_formatting(spark, folder):
    return text.outlier_display(named_outliers(spark, folder), "company", "p_type")
