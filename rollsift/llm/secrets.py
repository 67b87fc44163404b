"""Secret scanning with DataFrame functions only; no shuffle, no Python on the executors.

Base rules are patterns. The method adds candidates: runs of key-like
characters, classed as hexadecimal, mixed (with a digit) or letters (in both
cases), over which a window slides. Each step counts the character that comes in
and the one that goes out, and moves the sum of c*log2(c) that gives the Shannon
entropy by those two counts. A candidate whose best window reaches its class's
threshold is a span unless the allow list knows its shape or a base span covers
it. Parts between separators that are words for examples are left out of the
windows, so that a key beside one is still seen.

Work grows in proportion to the text: positions and coverage come from running
sums and maxima in two levels (``running``), windows from their own characters.
Positions are code points, ends exclusive. Edge cases: a null text counts as
empty; an empty text has no spans; an empty table gives no rows; a null id stays
null; repeated rows are scanned each on its own; a very long text is scanned
whole, in one task; other columns are ignored by ``report`` and kept by ``scan``
and ``redact``, whatever their names in the latter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollsift.llm.common import whole_text

# Kinds in their order, and their patterns.
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_letters"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
NUMBER = r"^[0-9+/_=-]+$"  # numbers, dates, telephone numbers, rules
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # uuid
    r"^[A-Za-z]++(?:[/_+-][A-Za-z]*+)*+[0-9]{1,4}$",  # a name or path with a number at its end
    r"^(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_+-](?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))++$",  # words and short numbers between separators
]  # nothing is given back, so that they take time in proportion to a candidate of any length
PLACEHOLDER = r"(?i)(^|[/_+-])(example|sample|placeholder|x{6,})([/_+-]|={0,2}$)"  # a whole part; what follows it stays

WINDOW = 20
CLASSES = {
    "entropy_hex": lambda v: v.rlike("^[0-9a-fA-F]*$") & v.rlike("[0-9]"),
    "entropy_mixed": lambda v: v.rlike("[0-9]") & ~v.rlike("^[0-9a-fA-F]*$"),
    "entropy_letters": lambda v: ~v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]"),
}
THRESHOLDS = {"entropy_hex": 3.0, "entropy_mixed": 3.7, "entropy_letters": 4.1}
#: Items of a list that ``running`` goes through at once.
STRIDE = 128
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running(values: Column, combine) -> Column:
    """array<int>: the values combined up to each place. Lists grow by copying, so they grow in strides: first the
    strides' own results, then what comes before each stride, then the places inside."""
    none = F.array().cast("array<int>")
    last = F.floor((F.size(values) - 1) / STRIDE).cast("int")
    strides = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * STRIDE + 1, F.lit(STRIDE)))
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    fold = lambda stride: F.aggregate(stride, F.lit(0), combine)
    before = F.aggregate(
        strides, zero, lambda acc, stride: F.struct(combine(acc["at"], fold(stride)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"]
    )

    def inside(part: Column) -> Column:
        start = F.struct(part["before"].alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(combine(acc["at"], x))).alias("out"))
        return F.aggregate(part["stride"], start, step, lambda acc: acc["out"])

    parts = F.arrays_zip(strides.alias("stride"), before.alias("before"))
    return F.when(F.size(values) > 0, F.flatten(F.transform(parts, inside))).otherwise(none)


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds for each name an array<struct<start, end, value>> of its pattern's leftmost matches that don't overlap.

    The text between the matches and the matches themselves measure each other's places."""
    found = df.withColumns({f"{n}_values": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for n, p in patterns.items()})
    gap = lambda n, p: F.transform(F.split(F.col(text), p, -1), F.length)
    found = found.withColumns({f"{n}_steps": F.when(F.size(f"{n}_values") > 0, F.zip_with(F.transform(f"{n}_values", F.length), gap(n, p), lambda x, y: x + y)) for n, p in patterns.items()})
    found = found.withColumns({f"{n}_ends": running(F.filter(f"{n}_steps", lambda x: x.isNotNull()), lambda x, y: x + y) for n in patterns})
    span = lambda value, end: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    spans = {n: F.coalesce(F.zip_with(f"{n}_values", f"{n}_ends", span), none) for n in patterns}
    return found.withColumns(spans).drop(*[f"{n}_{part}" for n in patterns for part in ("values", "steps", "ends")])


def of_kind(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))).cast(SPAN)


def _weight(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def best_window_entropy(value: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits a character) of the string's windows, by incremental counts.

    The window itself is the count: of a character it holds as many as it gets shorter without it."""

    def step(acc: Column, came: Column) -> Column:
        full = F.length(acc["recent"]) == window
        went = F.when(full, F.substring(acc["recent"], 1, 1)).otherwise(F.lit(""))
        count = lambda ch: F.length(acc["recent"]) - F.length(F.replace(acc["recent"], ch, F.lit("")))
        more, less = count(came), count(went)
        change = _weight(more + 1) - _weight(more) + F.when(full, _weight(less - 1) - _weight(less)).otherwise(F.lit(0.0))
        total = acc["total"] + F.when(came == went, F.lit(0.0)).otherwise(change)
        recent = F.concat(F.when(full, F.substring(acc["recent"], 2, window - 1)).otherwise(acc["recent"]), came)
        bits = F.log2(F.lit(float(window))) - total / F.lit(float(window))
        complete = F.length(acc["recent"]) >= window - 1
        return F.struct(recent.alias("recent"), total.alias("total"), F.when(complete, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    zero = F.struct(F.lit("").alias("recent"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
    return F.aggregate(F.split(value, ""), zero, step, lambda acc: acc["best"])


def allowed(value: Column) -> Column:
    """The allow list knows the candidate's shape."""
    out = value.rlike(NUMBER)
    for pattern in ALLOWED:
        out = out | value.rlike(pattern)
    return out


def scan(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """Adds the base spans and all spans, each sorted by start, then kind."""
    found = located(df.withColumn("_scanned", whole_text(text)), "_scanned", {"_assign": ASSIGN, "_access": ACCESS, "_hex": HEX, "_runs": CANDIDATE})
    long_value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6
    based = found.withColumn(
        base,
        F.array_sort(
            F.concat(
                of_kind(F.filter("_assign", long_value), "assign"),
                of_kind(F.filter("_access", lambda s: F.length(s["value"]) >= 20), "access"),
                of_kind(F.col("_hex"), "hex"),
            )
        ),
    )
    added = F.concat(*[of_kind(F.filter("_runs", _hot(kind)), kind) for kind in CLASSES])
    # in the order of starts, base spans first, a key is covered if a base span before it ends no earlier
    tagged = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("added"), s["end"].alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind")))
    placed = based.withColumn("_added", added).withColumn("_both", F.array_sort(F.concat(tagged(base, 0), tagged("_added", 1))))
    placed = placed.withColumn("_reach", running(F.transform("_both", lambda s: F.when(s["added"] == 0, s["end"]).otherwise(F.lit(0))), lambda x, y: F.greatest(x, y)))
    span = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    open_ = F.zip_with("_both", "_reach", lambda s, reach: F.when((s["added"] == 0) | (reach < s["end"]), span(s)))
    every = F.when(F.size("_added") > 0, F.array_sort(F.filter(open_, lambda s: s.isNotNull()).cast(SPAN))).otherwise(F.col(base))
    return placed.withColumn(spans, every).drop("_scanned", "_assign", "_access", "_hex", "_runs", "_added", "_both", "_reach")


def _hot(kind: str):
    """Whether a run is of the class, unknown to the allow list and has a window of the class's entropy."""

    def test(s: Column) -> Column:
        v = s["value"]
        best = best_window_entropy(F.regexp_replace(v, PLACEHOLDER, "$3"))
        return CLASSES[kind](v) & ~allowed(v) & (best >= THRESHOLDS[kind])

    return test


def listed(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    scanned = scan(df.select(doc_id, text), text)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(F.col(doc_id).alias("doc_id"), *[count(k) for k in KINDS[:3]], F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))


def redact(df: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The same rows and columns; spans of the text are replaced by ``mark``, overlapping ones by one.

    The columns travel in a struct, so that none clashes with those of the scan."""
    names = df.columns
    df = df.select(F.struct(*names).alias("_row"), F.col(text).alias("_kept"))
    text, out = "_kept", text
    scanned = scan(df, text, "_base", "_spans")
    # four bytes a code point, so that a piece is found without reading what is before it
    reach = running(F.transform("_spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    scanned = scanned.withColumn("_reach", reach).withColumn("_wide", F.when(F.size("_spans") > 0, F.encode(F.col(text), "UTF-32")))
    before = F.concat(F.array(F.lit(0)), F.col("_reach"))
    piece = lambda start, end: F.decode(F.substr(F.col("_wide"), start * 4 + 1, (end - start) * 4), "UTF-32")
    kept = F.zip_with(F.transform("_spans", lambda s: s["start"]), before, lambda start, at: F.when(start.isNull(), F.decode(F.substr(F.col("_wide"), at * 4 + 1), "UTF-32")).when(start >= at, F.concat(piece(at, start), F.lit(mark))).otherwise(F.lit("")))
    redacted = F.when(F.size("_spans") > 0, F.array_join(kept, "")).otherwise(F.col(text))
    return scanned.select(*[redacted.alias(n) if n == out else F.col("_row").getField(n).alias(n) for n in names])
