"""Benchmark passages in documents: a prefix-filtered set join of word shingles, in native expressions only.

A window is ``window`` consecutive words of an item (the whole item, if it has fewer); its tokens are its shingles of
``shingle`` words. A window lies in a document only if all of its shingles do, so the prefix that has to agree is one
shingle: the rarest, by the number of documents that hold it.

1. One pass over the texts finds the places of all item shingles: the shingles' hashes are broadcast, in blocks of at
   most ``BLOCK`` rows, and words are compared where hashes agree. Texts and words never leave their task.
2. A document's places and the windows meet at the windows' rarest shingles. Length and position bound the start of the
   window; then its shingles must stand at successive places, which is exact.
3. Documents with the same windows share a set; items are looked up and joined to text once a set.

Edge cases: null, empty or wordless texts have no words and no hits; items without id, text or words are no items;
items that repeat an id are one item that has the windows of all its texts; equal rows of documents each give a row;
rows without id are documents like others; empty tables give no rows or no hits; other columns are ignored. A document
has one row in memory: its words and at most as many places as it has words, for each shingle length in use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import materialise

WINDOW, SHINGLE = 10, 5
#: Rows of shingles or windows that are broadcast at once; more of them come in several blocks.
BLOCK = 200_000
#: What stands between words, in either case.
BETWEEN = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    """Words with A-Z in lower case; a null text has none."""
    plain = lambda w: F.when(F.length(w) == F.octet_length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), BETWEEN), ""), plain)


def _named(parts: Column) -> Column:
    """Sixteen bytes that tell lists of words apart."""
    return F.unhex(F.md5(F.array_join(parts, " ")))


def _runs(array: str, n: Column) -> Column:
    """All runs of ``n`` elements, in order; none, if there are fewer."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array) - n + 1, F.lit(1)))
    return F.when(F.size(array) >= n, F.transform(starts, lambda i: F.slice(array, i, n))).otherwise(F.array().cast("array<array<string>>"))


def _windows(benchmark: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, their texts, the texts' items): (wid, words, k, sids), (wid, tid), (tid, item_id)."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("_words")).where(F.size("_words") > 0)
    named, _ = materialise(items.select("item_id", _named(F.col("_words")).alias("tid"), "_words"), "items")
    texts = named.groupBy("tid").agg(F.first("_words").alias("_words"))
    cut = texts.select("tid", F.explode(_runs("_words", F.least(F.size("_words"), F.lit(window)))).alias("words"))
    pairs, _ = materialise(cut.select(_named(F.col("words")).alias("wid"), "tid", "words"), "windows")
    k = F.least(F.size("words"), F.lit(shingle))
    distinct = pairs.groupBy("wid").agg(F.first("words").alias("words")).withColumn("k", k)
    whole, _ = materialise(distinct.withColumn("sids", F.transform(_runs("words", F.col("k")), _named)), "distinct-windows")
    return whole, pairs.select("wid", "tid").distinct(), named.select("tid", "item_id").distinct()


def _blocks(df: DataFrame, key: str, most: int) -> list[DataFrame]:
    """The rows in parts of about ``most`` rows, by a hash of the key."""
    parts = -(-df.count() // most)
    return [df] if parts < 2 else [df.where(F.pmod(F.xxhash64(F.lit(7), key), F.lit(parts)) == i) for i in range(parts)]


def _places(documents: DataFrame, shingles: DataFrame, sizes: list[int], block: int) -> DataFrame:
    """(doc_id, text_key, n_words, first, place): a row for the first word of every document, and one for each place of a shingle."""
    d = documents.select("doc_id", F.xxhash64("text").alias("text_key"), words("text").alias("_words"))
    d = d.select("doc_id", "text_key", "_words", F.size("_words").alias("n_words"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    # the outer form: the inner one would evaluate the words again in a filter of its own
    at = d.select("doc_id", "text_key", "_words", "n_words", "_hashes", F.posexplode_outer("_hashes").alias("pos", "_hash"))
    key = lambda k: F.xxhash64(F.lit(k), "_hash", *[F.get("_hashes", F.col("pos") + j) for j in range(1, k)])
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if len(sizes) == 1:
        at = at.withColumn("k", F.lit(sizes[0])).withColumn("_key", key(sizes[0])).withColumn("first", first)
    else:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), key(k).alias("key")) for k in sizes]))
        at = at.withColumn("_each", each).withColumn("k", F.col("_each.k")).withColumn("_key", F.col("_each.key")).withColumn("first", first & (F.col("k") == sizes[0]))
    found = []
    for i, part in enumerate(_blocks(shingles, "_shingle_key", block)):
        same = (F.col("_key") == F.col("_shingle_key")) & (F.slice("_words", F.col("pos") + 1, F.col("k")) == F.col("_shingle"))
        met = at.join(F.broadcast(part), same, "left")  # at most about BLOCK rows
        place = F.when(F.col("sid").isNotNull(), F.struct("k", "pos", "sid"))
        keep = F.col("sid").isNotNull() | F.col("first") if i == 0 else F.col("sid").isNotNull()
        found.append(met.where(keep).select("doc_id", "text_key", "n_words", (F.col("first") if i == 0 else F.lit(False)).alias("first"), place.alias("place")))
    return reduce(DataFrame.unionByName, found)


def _rarest(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows all of whose shingles some document holds: (wid, k, n, sids, sid, offset), with the shingle in the fewest documents."""
    seen = docs.select("copies", F.explode(F.array_distinct("sids")).alias("sid")).groupBy("sid").agg(F.sum("copies").alias("_docs"))
    each = windows.select("wid", "k", F.size("words").alias("n"), "sids", F.posexplode("sids").alias("offset", "sid"))
    rare = F.min_by(F.struct("sid", "offset"), F.struct("_docs", "offset"))
    kept = each.join(seen, "sid").groupBy("wid", "k", "n", "sids").agg(F.count("*").alias("_met"), rare.alias("_rare")).where(F.col("_met") == F.size("sids"))
    return kept.select("wid", "k", "n", "sids", "_rare.sid", "_rare.offset")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, sets): a row for each row of documents with doc_id, n_words, n_hit, ``spans`` of hit words (start,
    end exclusive) and ``item_set``, null without hits; a row for each set with item_set and ``item_ids``, strings in order."""
    windows, texts, items = _windows(benchmark, window, shingle)
    runs = windows.select(F.explode(F.arrays_zip(F.col("sids").alias("sid"), _runs("words", F.col("k")).alias("words"))).alias("x"), "k").select("k", "x.sid", F.col("x.words").alias("_shingle"))
    hashed = F.transform("_shingle", lambda w: F.xxhash64(w))
    shingles = runs.groupBy("sid").agg(F.first("k").alias("_k"), F.first("_shingle").alias("_shingle")).withColumn("_h", hashed)
    sizes = sorted(r[0] for r in windows.select("k").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    key = F.lit(None).cast("long")
    for k in sizes:
        key = F.when(F.col("_k") == k, F.xxhash64(F.lit(k), *[F.get("_h", F.lit(j)) for j in range(k)])).otherwise(key)
    shingles, _ = materialise(shingles.select("sid", "_shingle", key.alias("_shingle_key")), "shingles")

    one = ["doc_id", "text_key", "n_words"]
    found = _places(documents, shingles, sizes, block)
    places = found.groupBy(*one).agg(F.count_if("first").alias("copies"), F.sort_array(F.collect_set("place")).alias("p"))
    docs, _ = materialise(places.select(*one, "copies", F.col("p.k").alias("ks"), F.col("p.pos").alias("places"), F.col("p.sid").alias("sids")), "places")
    rare, _ = materialise(_rarest(windows, docs), "rarest")

    one = [*one, "copies"]
    # no lambdas here: without them the rows of a document are generated, joined and dropped where its arrays are
    at = docs.select(*one, "ks", "places", F.col("sids").alias("_sids"), F.posexplode_outer("places").alias("i", "pos")).withColumn("_sid", F.get("_sids", "i"))
    first, count = F.col("i") - F.col("offset"), F.size("sids")
    start, last = F.col("pos") - F.col("offset"), first + count - 1
    bounds = (first >= 0) & (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    row = (F.get("ks", first) == F.col("k")) & (F.get("places", first) == start) & (F.get("ks", last) == F.col("k")) & (F.get("places", last) == start + count - 1)
    same = F.slice("_sids", F.greatest(first, F.lit(0)) + 1, count) == F.col("sids")
    hits = []
    for i, part in enumerate(_blocks(rare, "wid", block)):
        met = (at if i == 0 else at.where("pos is not null")).join(F.broadcast(part), (F.col("_sid") == F.col("sid")) & bounds & row & same, "left" if i == 0 else "inner")  # at most about BLOCK rows
        hits.append(met.select(*one, F.when(F.col("wid").isNotNull(), F.struct(start.alias("start"), (start + F.col("n")).alias("end"), "wid")).alias("hit")))
    gathered = reduce(DataFrame.unionByName, hits).groupBy(*one).agg(F.collect_set("hit").alias("hits"))

    hit = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["end"] - 1)))))
    starts = F.filter("_hit", lambda x, i: (i == 0) | (F.get("_hit", i - 1) != x - 1))
    ends = F.transform(F.filter("_hit", lambda x, i: (i == F.size("_hit") - 1) | (F.get("_hit", i + 1) != x + 1)), lambda x: x + 1)
    wids = F.array_sort(F.array_distinct(F.col("hits.wid")))
    item_set = F.when(F.size("_wids") > 0, F.sha2(F.array_join(F.transform("_wids", lambda x: F.hex(x)), ""), 256))
    marked = gathered.select(*one, hit.alias("_hit"), wids.alias("_wids")).select(
        "doc_id", "n_words", "copies", F.size("_hit").alias("n_hit"), F.arrays_zip(starts.alias("start"), ends.alias("end")).alias("spans"), item_set.alias("item_set"), "_wids",
    )
    marked, _ = materialise(marked, "marked")

    sets = marked.where("item_set is not null").groupBy("item_set").agg(F.first("_wids").alias("_wids")).select("item_set", F.explode("_wids").alias("wid"))
    named = sets.join(texts, "wid").select("item_set", "tid").distinct().join(items, "tid")
    named = named.groupBy("item_set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = marked.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"), "spans", "item_set"), named


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of documents."""
    rows, sets = contamination(documents, benchmark, window, shingle, block)
    digests, _ = materialise(sets.select("item_set", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")), "item-sets")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    clean = rows.where("item_set is null").withColumn("n_items", F.lit(0).cast("long")).withColumn("items_sha256", F.sha2(F.lit(""), 256)).withColumn("contaminated", F.lit(False))
    hit = rows.where("item_set is not null").join(digests, "item_set").withColumn("contaminated", F.lit(True))
    return clean.select(*columns).unionByName(hit.select(*columns))
