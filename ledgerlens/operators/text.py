"""Text consistency: association outliers, keyword rules, vector similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder
from ..functions.values import share
from .joins import BROADCAST_BYTES, attach, not_null, pin

#: keyword rules in priority order: (label, keywords)
Rules = list[tuple[str, list[str]]]
#: characters of a gram in the index of a rule table
GRAM = 3


def association_stats(
    df: DataFrame, company: str, trade: str, max_share: float = 0.2
) -> DataFrame:
    """Per (company, trade): count, share of the company's rows, outlier flag.

    An outlier is a rare trade of a company with several trades. Counts are
    combined before each shuffle, and totals are joined back instead of windowed, so
    a company with very many trades stays splittable.
    """
    pairs = (
        not_null(df.select(company, trade), [company, trade])
        .groupBy(company, trade)
        .agg(F.count(F.lit(1)).alias("pair_count"))
    )
    totals = pairs.groupBy(company).agg(
        F.sum("pair_count").alias("total_count"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return (
        attach(pairs, totals, company)
        .withColumn("ratio", share(F.col("pair_count"), F.col("total_count")))
        .withColumn(
            "is_outlier", (F.col("trade_count") > 1) & (F.col("ratio") < F.lit(max_share))
        )
    )


def keyword_verdict(company: Column, trade: Column, rules: Rules) -> Column:
    """Does the company name support the trade?

    ``CONFIRMED_BY_NAME`` if a keyword of the own trade occurs in the name, else
    ``CONFLICT_WITH_<LABEL>`` for the first other rule that matches, else
    ``NO_KEYWORD_INFO``. Keywords are plain substrings of the lowercased name.
    """
    return _verdict(matching_labels(company, rules_array(rules)), trade)


def rules_array(rules: Rules) -> Column:
    """Rules as one array of (label, lower-case words) in order of priority.

    For a list of rules, which becomes a literal; ``rule_labels`` takes a table.
    """
    if not rules:
        return F.array().cast("array<struct<label:string,words:array<string>>>")
    words = [F.array(*[F.lit(w.lower()) for w in found]).cast("array<string>") for _, found in rules]
    return F.array(
        *[F.struct(F.lit(r[0]).alias("label"), w.alias("words")) for r, w in zip(rules, words)]
    )


def matching_labels(company: Column, rules: Column) -> Column:
    """Labels of the rules with a keyword in the name, by priority.

    The plan has one lambda whatever the number of rules, so it compiles for any table.
    """
    name = F.lower(company)
    hit = F.filter(rules, lambda r: F.exists(r["words"], lambda w: F.contains(name, w)))
    return F.transform(hit, lambda r: r["label"])


def _verdict(labels: Column, trade: Column) -> Column:
    other = F.filter(labels, lambda label: ~label.eqNullSafe(trade))
    conflict = F.concat(F.lit("CONFLICT_WITH_"), F.upper(F.try_element_at(other, F.lit(1))))
    confirmed = F.when(F.array_contains(labels, trade), F.lit("CONFIRMED_BY_NAME"))
    return F.coalesce(confirmed, conflict, F.lit("NO_KEYWORD_INFO"))


def keyword_index(rules: DataFrame) -> DataFrame:
    """Inverted index of a rule table: (size, gram, word, priority, label).

    Each keyword stands under one of its grams, the one that the fewest keywords hold (of
    equal ones the first by text). Grams have three characters; a shorter keyword is its
    own gram.
    """
    words = rules.select("priority", "label", F.explode("keywords").alias("word"))
    words = words.select("priority", "label", F.lower("word").alias("word")).where("word IS NOT NULL")
    words = words.distinct()
    size = F.least(F.length("word"), F.lit(GRAM))
    grams = words.select("word").distinct().select("word", size.alias("size"))
    grams = grams.select("word", "size", F.explode(grams_of("word", F.col("size"))).alias("gram"))
    held = grams.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("held"))
    rated = attach(grams, held, ["size", "gram"])
    best = rated.groupBy("word").agg(F.min(F.struct("held", "size", "gram")).alias("best"))
    return attach(words, best, "word", "inner").select(
        "best.size", "best.gram", "word", "priority", "label"
    )


def grams_of(text: str, size: Column) -> Column:
    """Distinct substrings of ``size`` characters; the empty one for size 0."""
    last = F.length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(text), i, size)))


def rule_labels(names: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """Distinct names with ``_labels``: distinct labels of the matching rules, by priority.

    The grams of the names are joined with the keywords' index, and what they find is
    verified on the whole keyword. So a name is compared with the few keywords that share
    a gram with it, whatever the number of rules, and no row holds all of them. Names
    without a match have no row.
    """
    index = pin(keyword_index(rules))
    sizes = F.array(*[F.lit(r["size"]) for r in index.select("size").distinct().collect()])  # 0 to GRAM
    own = names.select(F.col(name).alias("_name"), F.lower(name).alias("_text"))
    own = own.select("_name", "_text", F.explode(sizes.cast("array<int>")).alias("size"))
    own = own.select("_name", "_text", "size", F.explode(grams_of("_text", F.col("size"))).alias("gram"))
    met = attach(own, index, ["size", "gram"], "inner").where(F.contains("_text", "word"))
    found = met.groupBy("_name", "label").agg(F.min("priority").alias("priority"))
    found = found.groupBy("_name").agg(F.collect_list(F.struct("priority", "label")).alias("hits"))
    labels = F.transform(F.array_sort("hits"), lambda hit: hit["label"])
    return found.select(F.col("_name").alias(name), labels.alias("_labels"))


def with_keyword_verdict(
    df: DataFrame, company: str, trade: str, rules: Rules | DataFrame, name: str = "check_result"
) -> DataFrame:
    """Add the verdict; each distinct name is matched with the keywords once.

    ``rules`` is a list in order of priority or a table (priority, label, keywords).
    """
    names = not_null(df.select(F.col(company).alias("_name")), ["_name"]).distinct()
    names = names.withColumnRenamed("_name", company)
    if isinstance(rules, DataFrame):
        labelled = rule_labels(names, company, rules)
    else:
        labels = matching_labels(F.col(company), F.col("_rules")).alias("_labels")
        labelled = names.withColumn("_rules", rules_array(rules)).select(company, labels)
    labels = F.coalesce("_labels", F.array().cast("array<string>"))
    verdict = _verdict(labels, F.col(trade))
    return attach(df, labelled, company).withColumn(name, verdict).drop("_labels")


def association_outliers(
    stats: DataFrame, company: str, trade: str, rules: Rules | DataFrame
) -> DataFrame:
    """Flagged pairs only, with the verdict of the keyword rules."""
    return with_keyword_verdict(stats.filter("is_outlier"), company, trade, rules)


def encode_distinct(
    df: DataFrame,
    column: str,
    encoder: Encoder,
    batch_size: int = 128,
    partitions: int | None = None,
) -> DataFrame:
    """One unit vector per distinct non-null value: columns ``value``, ``vector``.

    Each distinct value is encoded once, in Arrow batches on the executors. The values
    are spread over ``partitions`` tasks (default: one per core of the cluster), as the
    encoder is what costs; without that a small set of values would be one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                texts = batch["value"].iloc[start : start + batch_size].tolist()
                yield pd.DataFrame(
                    {"value": texts, "vector": [v.tolist() for v in encoder(texts)]}
                )

    values = not_null(df.select(F.col(column).alias("value")), ["value"]).distinct()
    tasks = partitions or max(df.sparkSession.sparkContext.defaultParallelism, 2)
    # by a hash: Spark would take a shuffle on the value itself for the one just made
    values = values.repartition(tasks, F.xxhash64("value"))
    return values.mapInPandas(run, "value string, vector array<double>")


def ngram_weights(df: DataFrame, column: str, dimension: int = 64, size: int = 3) -> DataFrame:
    """Built-in encoder: hashed character n-grams as sparse unit vectors.

    Rows (``value``, ``place``, ``weight``), one per place that a value's n-grams fall
    into. The lower-cased value is padded by ``size`` - 1 spaces in front and one behind;
    an n-gram counts in the place that the first 32 bits of its MD5 give. Each n-gram of
    each distinct value is hashed once, before it is counted.
    """
    values = not_null(df.select(F.col(column).alias("value")), ["value"]).distinct()
    padded = F.concat(F.lit(" " * (size - 1)), F.lower("value"), F.lit(" "))
    places = F.sequence(F.lit(1), F.char_length(padded) - (size - 1))
    grams = values.select("value", F.explode(F.transform(places, lambda i: F.substring(padded, i, size))).alias("gram"))
    # never null, and said so, as Spark would else test the hash for null in a filter, too
    place = F.coalesce(F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("long") % dimension, F.lit(0))
    counts = grams.select("value", place.cast("int").alias("place")).groupBy("value", "place").count()
    norms = counts.groupBy("value").agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("norm"))
    return counts.join(norms, "value").select("value", "place", (F.col("count") / F.col("norm")).alias("weight"))


def ngram_vectors(df: DataFrame, column: str, dimension: int = 64, size: int = 3) -> DataFrame:
    """``ngram_weights`` as dense vectors: (``value``, ``vector``), one row per value."""
    weights = ngram_weights(df, column, dimension, size)
    cells = weights.groupBy("value").agg(
        F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("cells")
    )
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    vector = F.transform(places, lambda k: F.coalesce(F.col("cells")[k], F.lit(0.0)))
    return cells.select("value", vector.alias("vector"))


def dot(left: Column, right: Column) -> Column:
    """Sum of products of two number arrays."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _with_norm(vectors: DataFrame, name: str, vector: str) -> DataFrame:
    """(value, vector) as named columns, with the vector's length."""
    return vectors.select(
        F.col("value").alias(name),
        F.col("vector").alias(vector),
        F.sqrt(dot(F.col("vector"), F.col("vector"))).alias(f"{vector}_norm"),
    )


def semantic_mismatches(
    df: DataFrame,
    company: str,
    trade: str,
    company_vectors: DataFrame,
    trade_vectors: DataFrame,
    threshold: float = 0.2,
    ordered: bool = True,
) -> DataFrame:
    """Rows whose two names are less similar than the threshold, least similar first.

    The vector tables have columns ``value`` and ``vector``. Vectors are joined to
    the distinct name pairs, not to the rows; only pairs below the threshold go back
    to the rows. A zero vector has no similarity and never matches. The order uses
    all columns after the similarity, so that rows of a frequent pair spread over the
    sorted partitions; ``ordered=False`` leaves the sort to the reader of a stored
    result.

    Trades are few as a rule: where their counted bytes allow it they are broadcast, and
    a vector is shuffled once, with its company; else the pairs are shuffled by trade.
    """
    pairs = not_null(df.select(company, trade), [company, trade]).distinct()
    companies = _with_norm(company_vectors, company, "_left")
    trades = _small_or_not(_with_norm(trade_vectors, trade, "_right"), "_right")
    scored = attach(pairs, companies, company, "inner")
    scored = scored.join(F.broadcast(trades[0]), trade) if trades[1] else attach(scored, trades[0], trade, "inner")
    cosine = F.try_divide(
        dot(F.col("_left"), F.col("_right")), F.col("_left_norm") * F.col("_right_norm")
    )
    scored = scored.select(company, trade, cosine.alias("similarity"))
    return _below(df, company, trade, scored, threshold, ordered)


def sparse_mismatches(
    df: DataFrame,
    company: str,
    trade: str,
    company_weights: DataFrame,
    trade_weights: DataFrame,
    threshold: float = 0.2,
    ordered: bool = True,
) -> DataFrame:
    """``semantic_mismatches`` over sparse unit vectors (``value``, ``place``, ``weight``).

    The product of two vectors is a join on the place and one sum per pair of names;
    places that only one of them has add nothing. Pairs without a common place have
    similarity 0; names without a vector never match.
    """
    pairs = not_null(df.select(company, trade), [company, trade]).distinct()
    known = trade_weights.select(F.col("value").alias(trade)).distinct()
    pairs = attach(pairs, known, trade, "left_semi")
    left = company_weights.select(
        F.col("value").alias(company), F.col("place").alias("_place"), F.col("weight").alias("_left")
    )
    right = trade_weights.select(
        F.col("value").alias(trade), F.col("place").alias("_place"), F.col("weight").alias("_right")
    )
    cells = attach(attach(pairs, left, company, "inner"), right, [trade, "_place"])
    product = F.coalesce(F.col("_left") * F.col("_right"), F.lit(0.0))
    scored = cells.groupBy(company, trade).agg(F.sum(product).alias("similarity"))
    return _below(df, company, trade, scored, threshold, ordered)


def _small_or_not(vectors: DataFrame, vector: str) -> tuple[DataFrame, bool]:
    """Pinned vectors, and whether their counted bytes may be broadcast."""
    pinned = pin(vectors)
    held = pinned.agg(F.sum(F.size(vector) * F.lit(8) + F.lit(64))).first()[0] or 0
    return pinned, held <= BROADCAST_BYTES


def _below(
    df: DataFrame, company: str, trade: str, scored: DataFrame, threshold: float, ordered: bool
) -> DataFrame:
    """Rows of the pairs whose similarity is below the threshold."""
    low = scored.filter(F.col("similarity") < F.lit(threshold))
    found = attach(df, low, [company, trade], "inner").select(*df.columns, "similarity")
    if not ordered:
        return found
    ties = [c for c in df.columns if c not in (company, trade)]
    return found.orderBy("similarity", company, trade, *ties)


def percent_text(ratio: Column) -> Column:
    """``0.1234`` → ``12.34%``."""
    return F.format_string("%.2f%%", F.bround(ratio * 100, 2))


def outlier_display(outliers: DataFrame, company: str, trade: str) -> DataFrame:
    """Listing for readers: percent text and display names."""
    return outliers.withColumn("ratio", percent_text(F.col("ratio"))).select(
        F.col(company).alias("company"),
        F.col(trade).alias("trade (order)"),
        F.col("pair_count").alias("orders"),
        F.col("ratio").alias("share of volume"),
        F.col("check_result").alias("name check"),
    )
