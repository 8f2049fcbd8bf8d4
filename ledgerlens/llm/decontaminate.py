"""Benchmark decontamination: n-grams of test items, looked up in training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import pin
from .common import column, if_small, skewed_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what a word is, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: test windows whose hashes are broadcast in one pass over the documents: about 50 MB as a hash table
PASS_HASHES = 1_000_000
#: bytes of an MD5 in hexadecimal as a row of a hash table
DIGEST_BYTES = 96


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def gram_at(words: Column, start: Column, size: int) -> Column:
    """``size`` words from ``start`` (1-based), joined by spaces."""
    return F.concat_ws(" ", *[F.element_at(words, (start + k).cast("int")) for k in range(size)])


def hash_at(words: Column, start: Column, size: int) -> Column:
    """Hash of ``size`` words from ``start`` (1-based) and of their number, without joining them."""
    return F.xxhash64(F.lit(size), *[F.element_at(words, (start + k).cast("int")) for k in range(size)])


def starts(words: Column, size: int) -> Column:
    """Start places of all windows of ``size`` words."""
    number = F.size(words)
    return F.when(number >= size, F.sequence(F.lit(1), number - (size - 1))).otherwise(
        F.array().cast("array<int>")
    )


def test_windows(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """(item, gram, n): every window of ``size`` words; a shorter item is one window."""
    cut = items.select(column(item_id).cast("string").alias("item"), words_of(column(text)).alias("w"))
    cut = cut.where("item IS NOT NULL AND size(w) > 0")
    whole = cut.where(F.size("w") < size).select("item", F.concat_ws(" ", "w").alias("gram"), F.size("w").alias("n"))
    long = cut.where(F.size("w") >= size)
    grams = F.transform(starts(F.col("w"), size), lambda i: gram_at(F.col("w"), i, size))
    long = long.select("item", F.explode(grams).alias("gram"), F.lit(size).alias("n"))
    return long.unionByName(whole).distinct()


def covered(spans: Column) -> Column:
    """Words inside the union of (start, size) windows, which come sorted by start."""
    begin = F.struct(F.lit(1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, span: Column) -> Column:
        end = (span["start"] + span["n"]).cast("long")
        new = F.greatest(end, acc["end"])
        fresh = new - F.greatest(acc["end"], span["start"].cast("long"))
        return F.struct(new.alias("end"), (acc["n"] + F.greatest(fresh, F.lit(0).cast("long"))).alias("n"))

    return F.aggregate(spans, begin, add, lambda acc: acc["n"])


def with_words(text: Column, make) -> Column:
    """``make(words)`` with the words cut out once.

    The words are bound as a lambda variable: as a column of their own, a filter that
    Spark moves below it would cut the text anew for every window.
    """
    words = F.coalesce(words_of(text), F.array().cast("array<string>"))
    return F.transform(F.array(words), make)[0]


def hash_table(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(hash, n) of every distinct test window, pinned."""
    words = windows.select("gram", "n").distinct().withColumn("w", F.split("gram", " "))
    made = F.lit(None).cast("long")
    for n in sizes:
        made = F.when(F.col("n") == n, hash_at(F.col("w"), F.lit(1), n)).otherwise(made)
    return pin(words.select(made.alias("hash"), "n").distinct())


def looked_up(texts: DataFrame, keep: list[str], hashes: DataFrame, sizes: list[int], first: bool) -> DataFrame:
    """Rows (keep, digest, n_words, copy, span) of one pass: a text's hits, and a row without a span.

    The window hashes of a text, shorter windows first, are one array; place 0 stands for
    the text itself, which ``first`` counts as a copy. That row is there in every pass:
    the generated code of a plan that emits nothing for most texts ended the JVM (SIGSEGV
    in the slice of words; cause not found). Place and size of a hit give its start. Only hits get their words
    joined, as all between is one stage that writes no row.
    """
    def hashes_of(words: Column, size: int) -> Column:
        return F.transform(starts(words, size), lambda i: hash_at(words, i, size))

    def look(words: Column) -> Column:
        own = [hashes_of(words, n) for n in sizes]
        return F.struct(words.alias("w"), F.concat(F.array(F.lit(0).cast("long")), *own).alias("h"))

    cut = texts.select(*keep, "digest", with_words(F.col("_text"), look).alias("_f"))
    # explode_outer: for a plain one Spark adds a filter that would hash all windows twice
    rows = cut.select(*keep, "digest", F.col("_f.w").alias("w"), F.posexplode_outer("_f.h").alias("place", "hash"))
    number, found = F.size("w"), rows.join(F.broadcast(hashes), "hash", "left")
    before = F.lit(0)
    start = F.lit(None).cast("int")
    for n in sizes:
        start = F.when(F.col("n") == n, F.col("place") - before).otherwise(start)
        before = before + F.greatest(number - (n - 1), F.lit(0))
    hit = (F.col("place") > 0) & F.col("n").isNotNull() & start.between(1, number - F.col("n") + 1)
    itself = F.col("place") == 0
    found = found.where(F.coalesce(hit, F.lit(False)) | itself)
    gram = F.concat_ws(" ", F.slice("w", start, F.col("n")))
    one = F.struct(start.cast("int").alias("start"), F.col("n").cast("int").alias("n"), gram.alias("gram"))
    copy = F.when(itself, int(first)).otherwise(0)
    return found.select(*keep, "digest", number.alias("n_words"), copy.alias("copy"), F.when(~itself, one).alias("span"))


def scan(
    docs: DataFrame, windows: DataFrame, keep: dict[str, str], text: str = "text",
    pass_hashes: int | None = None,
) -> DataFrame:
    """Kept columns of the documents, digest, n_words, copies, and ``spans``: (start, n, gram) found.

    ``windows`` is pinned and has (item, gram, n). The hash of every window of a text is
    looked up in a broadcast table of the test windows' hashes; more than ``pass_hashes``
    of these (default ``PASS_HASHES``) take several passes over the documents, each with
    its part of the hashes, by the same plan. No text is moved: what is shuffled is a slim
    row per text and the hits, combined per text. Equal rows become one with their number. Hits are verified on their words.
    """
    limit = pass_hashes or PASS_HASHES
    sizes = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]  # 1 to size
    hashes = hash_table(windows, sizes)
    passes = max(1, -(-hashes.count() // limit))
    source = docs.select(*(column(c).alias(n) for n, c in keep.items()), column(text).alias("_text"))
    source = source.withColumn("digest", F.md5(F.col("_text").cast("binary")))
    found = None
    for k in range(passes):
        part = hashes.where(F.pmod("hash", F.lit(passes)) == k)
        rows = looked_up(source, list(keep), part, sizes, k == 0)
        found = rows if found is None else found.unionByName(rows)
    spans = F.array_sort(F.collect_set("span")).alias("spans")
    texts = found.groupBy(*keep, "digest").agg(F.max("n_words").cast("long").alias("n_words"), F.sum("copy").alias("copies"), spans)
    return verified(pin(texts), windows)


def verified(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """Spans whose words are a test window; those of equal hashes alone go.

    Of the hits only the distinct grams are moved. That two texts of words share a 64-bit
    hash is rare, so the rows are mostly left as they are.
    """
    grams = texts.select(F.explode("spans.gram").alias("gram")).distinct()
    wrong = if_small(grams.join(windows.select("gram").distinct(), "gram", "left_anti"), 256)
    if wrong.isEmpty():
        return texts
    names = [c for c in texts.columns if c != "spans"]
    keys = F.struct(*names).alias("_key")
    each = texts.select(keys, F.explode_outer("spans").alias("span")).withColumn("gram", F.col("span.gram"))
    marked = each.join(wrong.withColumn("wrong", F.lit(True)), "gram", "left")
    right = marked.groupBy("_key").agg(F.collect_set(F.when(F.col("wrong").isNull(), F.col("span"))).alias("spans"))
    return right.select("_key.*", F.array_sort("spans").alias("spans"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", size: int = 10,
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and contaminated.

    A document word inside any occurrence of a test window is hit. Null and empty texts
    have no words; items without id or words have no window; equal items count each.
    Repeated rows each get their row (null ids too), an empty table gives an empty
    table, without items nothing is hit. Documents with hits – and only they – are
    joined with the items, on (id, hash of what was found), so that equal rows share
    one list.
    """
    windows = pin(test_windows(items, item_id, item_text, size))
    scanned = scan(docs, windows, {"doc_id": doc_id}, text)
    slim = scanned.select(
        "doc_id", "n_words", "copies", covered(F.col("spans")).alias("n_hit"),
        F.array_distinct("spans.gram").alias("grams"),
    ).withColumn("digest", F.md5(F.concat_ws("\n", "grams")))
    slim = slim.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_", "copies")
    slim = pin(slim)
    hit = slim.where(F.size("grams") > 0)
    lists = hit.groupBy("digest").agg(F.first("grams").alias("grams"))
    pairs = lists.select("digest", F.explode("grams").alias("gram"))
    pairs = skewed_join(pairs, windows.select("item", "gram"), ["gram"], "inner")
    found = pairs.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    joined = skewed_join(hit.drop("grams"), found, ["digest"], "left").select("doc_id", "n_words", "n_hit", "items")
    clean = slim.where(F.size("grams") == 0)
    clean = clean.select("doc_id", "n_words", "n_hit", F.array().cast("array<string>").alias("items"))
    return joined.unionByName(clean).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", size: int = 10) -> DataFrame:
    """Documents in which no test window occurs; their columns stay as they are.

    What the windows occur in is known by the texts' digests; rows are moved only if these
    outgrow a broadcast.
    """
    windows = pin(test_windows(items, "item_id", "text", size))
    hit = scan(docs, windows, {}, text).where(F.size("spans") > 0)
    hit = if_small(hit.select(F.col("digest").alias("_digest")), DIGEST_BYTES)
    digest = F.md5(column(text).cast("binary"))
    return docs.join(hit, digest == F.col("_digest"), "left_anti")
