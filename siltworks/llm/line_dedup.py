"""Fuzzy line dedup by MinHash, by DataFrame functions only.

Lines (parted by \\n, trimmed of blanks, tabs and \\r, lower-cased) are made
distinct by hash. Every distinct line gets a MinHash signature of its shingles of
SHINGLE characters: BANDS * ROWS minima, each of one 64-bit shingle hash under
another exclusive-or, so that a minimum is the hash nearest to the mask. Lines
that agree on all minima of a band share a bucket and are candidates.

Each bucket's lines are held against its most central line first. The links that
exact Jaccard similarity confirms are merged by distributed union-find. In buckets
that still hold several components further lines lead, by rounds: LEADS of each
bucket at first, LEADS times as many in each later round, chosen by a hash, until
all have led. A leading line is held against those lines of other components that
have not led before, and links are merged between rounds. So groups of copies
never expand to pairs, each candidate pair meets once at most, and no candidate
pair of different components goes unverified. Before shingle sets are compared, an
odd sketch rules pairs out for certain: of two sketches no more bits can differ
than shingles of the two lines.

Of each component the first occurrence (by doc_id, text, line number) stays.

Edge cases: blank lines always stay; a line under SHINGLE characters is one
shingle, so it is alike equal lines only; a null or empty text has no line to
remove; texts and lines of any length are taken whole; lines are equal if two
64-bit hashes agree, and of lines that agree in the first one only, those of one
text are compared and the others stay; rows that are equal in doc_id and text are
one document and come out alike; rows with a null doc_id take part, and come
first; an empty table gives no row; further columns are ignored or, where
documents are returned, left as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import Scratch, cut, read, release, table, with_new_text
from siltworks.llm.components import components

#: Characters in a shingle; a pair at the threshold is found with a chance of 1 - (1 - 0.8**ROWS)**BANDS = 0.985.
SHINGLE, ROWS, BANDS, THRESHOLD = 8, 4, 8, 0.8
#: 64-bit words of an odd sketch.
WORDS = 32
#: Lines of a bucket that lead in the first round, and the growth of their number from round to round.
LEADS = 32
#: Shingles that come as one row, so that an aggregate's buffers are written once for all of them.
AT_ONCE = 4
#: Bytes of a character in UTF-32, where each has a place that is known.
_WIDE = 4


def line_hashes(text: Column) -> Column:
    """For each line of ``text`` h and g, two hashes of the normalised line; null for blank lines."""
    each = F.transform(F.split(text, "\n", -1), normal)
    return F.transform(each, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"))))


def normal(line: Column) -> Column:
    """A line as it is compared."""
    return F.lower(trimmed(line))


def trimmed(line: Column) -> Column:
    """A line without the blanks, tabs and \\r at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and lines (array of h, g) of every row, without texts."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), line_hashes(F.col("text")).alias("lines"))


def distinct_lines(docs: DataFrame) -> DataFrame:
    """h, g, line and n (how often it stands in ``docs``) of every distinct line that isn't blank."""
    each = docs.select(F.explode(F.split("text", "\n", -1)).alias("raw")).select(trimmed(F.col("raw")).alias("raw")).where("raw != ''")
    each = each.select(F.lower("raw").alias("line"))  # after the filter, which would lower-case once more
    each = each.select(F.xxhash64("line").alias("h"), F.struct(F.xxhash64(F.lit(1), "line").alias("g"), "line").alias("own"))
    return each.groupBy("h").agg(F.min("own").alias("own"), F.count("*").alias("n")).select("h", "own.*", "n")


def masks() -> list[int]:
    """BANDS * ROWS masks that are spread evenly over the signed 64-bit integers."""
    step = (1 << 64) // (BANDS * ROWS)
    return [k * step + step // 2 - (1 << 63) for k in range(BANDS * ROWS)]


def signed(distinct: DataFrame) -> DataFrame:
    """h and bands (array of keys) of lines (h, line) of at least a shingle.

    Shingles are exploded, AT_ONCE to a row (the last one stands for those beyond
    the end), and reduced to minima by one aggregation on h, on which ``distinct``
    is partitioned already.
    """
    each = distinct.where(F.length("line") >= SHINGLE).select("h", F.encode("line", "UTF-32").alias("raw"), (F.length("line") - SHINGLE).alias("last"))
    each = each.select("h", "raw", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(AT_ONCE))).alias("i"))
    each = each.select("h", *(F.xxhash64(F.substring("raw", F.least(F.col("i") + j, "last") * _WIDE + 1, F.lit(SHINGLE * _WIDE))).alias(f"s{j}") for j in range(AT_ONCE)))
    least = each.groupBy("h").agg(
        *(F.min(F.least(*(F.col(f"s{j}").bitwiseXOR(F.lit(m)) for j in range(AT_ONCE)))).alias(f"m{k}") for k, m in enumerate(masks()))
    )
    keys = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    return least.select("h", F.array(*keys).alias("bands"))


def shingles(line: Column) -> Column:
    """The hashes of a line's shingles, repeats included."""

    def of(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), x["n"] - SHINGLE), lambda i: F.xxhash64(F.substring(x["raw"], i * _WIDE + 1, F.lit(SHINGLE * _WIDE))))

    # as an array's element the line is encoded once, not for every shingle
    own = F.array(F.struct(F.encode(line, "UTF-32").alias("raw"), F.length(line).alias("n")))
    return F.element_at(F.transform(own, of), 1)


def sketched(texts: DataFrame) -> DataFrame:
    """h, size (distinct shingles) and w0, w1 ...: the odd sketch, in which each shingle turns one bit."""
    each = texts.select("h", F.array_distinct(shingles(F.col("line"))).alias("all")).select("h", F.size("all").alias("size"), "all")
    each = each.select("h", "size", "all", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(AT_ONCE))).alias("i"))
    each = each.select("h", "size", *(F.get("all", F.col("i") + j).alias(f"s{j}") for j in range(AT_ONCE)))
    none = F.lit(0).cast("long")  # the bit of what is beyond the end
    bits = [F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(f"s{j}").bitwiseAND(63).cast("int")), none).alias(f"bit{j}") for j in range(AT_ONCE)]
    each = each.select("h", "size", *bits, *(F.coalesce(F.shiftright(f"s{j}", 6).bitwiseAND(WORDS - 1), none).alias(f"word{j}") for j in range(AT_ONCE)))

    def turned(k: int) -> Column:
        return reduce(Column.bitwiseXOR, (F.when(F.col(f"word{j}") == k, F.col(f"bit{j}")).otherwise(none) for j in range(AT_ONCE)))

    return each.groupBy("h").agg(F.first("size").alias("size"), *(F.bit_xor(turned(k)).alias(f"w{k}") for k in range(WORDS)))


def may_be_similar(a: str, b: str, threshold: float = THRESHOLD) -> Column:
    """False only where the sketches of ``a`` and ``b`` (structs) prove that the Jaccard similarity is below ``threshold``.

    At a similarity of t, sets of n and m elements differ in (n + m) * (1 - t) / (1 + t) elements.
    """
    differ = F.lit(0)
    for k in range(WORDS):
        differ = differ + F.bit_count(F.col(f"{a}.w{k}").bitwiseXOR(F.col(f"{b}.w{k}")))
    n, m = F.col(f"{a}.size"), F.col(f"{b}.size")
    at_most = (n + m) * ((1 - threshold) / (1 + threshold)) + 1e-6
    return (F.abs(n - m) <= at_most) & (differ <= at_most)


def similar(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The distinct ``pairs`` (a, b, size_a, size_b and further columns) whose lines' shingle sets have a Jaccard similarity of at least ``threshold``.

    The sets' sizes are known from the sketches, so only what both sets share is counted.
    """
    held = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("line_a")), "a")
    held = held.join(texts.select(F.col("h").alias("b"), F.col("line").alias("line_b")), "b")
    both = F.size(F.array_intersect(shingles(F.col("line_a")), shingles(F.col("line_b"))))
    held = held.select(*pairs.columns, both.alias("n"), (F.col("size_a") + F.col("size_b")).alias("all"))
    return held.where(F.col("n") >= threshold * (F.col("all") - F.col("n"))).select(*pairs.columns)


def sizes() -> list[Column]:
    """size_a and size_b of pairs with their sketches."""
    return [F.col(f"own_{x}.size").alias(f"size_{x}") for x in "ab"]


def turn(h: Column, in_bucket: Column) -> Column:
    """The round in which a line of a bucket leads: about LEADS ** k of its lines do so up to round k."""
    share = (F.pmod(F.xxhash64(F.lit(2), h), F.lit(1 << 30)) + 1) / F.lit(1 << 30)
    return F.greatest(F.lit(1), F.ceil(F.log(share * in_bucket) / F.log(F.lit(float(LEADS)))).cast("int"))


def meetings(members: DataFrame, sketches: DataFrame, now: int) -> DataFrame:
    """Distinct candidates a, b, root_a, root_b, size_a, size_b of round ``now``: lines of a bucket, of different components, of which one leads now and none did before.

    ``members`` are key, h, turn, root and lead_root. Of the component that the
    bucket's central line is in, no two lines meet: those that lead ask for the
    bucket's other lines only.
    """
    rest = members.where(F.col("turn") >= now).withColumn("apart", F.col("root") != F.col("lead_root"))
    rest = rest.join(sketches, "h")
    asked = F.explode(F.when(F.col("apart"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("asked")
    lead = rest.where(F.col("turn") == now).select("key", F.col("h").alias("a"), F.col("root").alias("root_a"), F.col("own").alias("own_a"), F.col("apart").alias("a_apart"), asked)
    rest = rest.select("key", F.col("h").alias("b"), F.col("root").alias("root_b"), F.col("own").alias("own_b"), F.col("apart").alias("asked"), (F.col("turn") > now).alias("later"))
    # where both lead, one order of the pair is enough
    once = F.col("later") | (F.col("asked") & (~F.col("a_apart") | (F.col("a") < F.col("b"))))
    met = lead.join(rest, ["key", "asked"]).where((F.col("root_a") != F.col("root_b")) & once & may_be_similar("own_a", "own_b"))
    met = met.select("a", "b", "root_a", "root_b", *sizes())
    turned = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(swap("a", "b"), swap("b", "a"), swap("root_a", "root_b"), swap("root_b", "root_a"), swap("size_a", "size_b"), swap("size_b", "size_a")).distinct()


def open_buckets(members: DataFrame) -> DataFrame:
    """``members`` of the buckets of which a line is apart; the others are done."""
    return members.join(members.where("root != lead_root").select("key").distinct(), "key", "left_semi")


def merged(of: DataFrame, more: DataFrame, name: str = "root") -> DataFrame:
    """``of`` with the components ``name`` renamed by ``more`` (node, root), of which each node is a component."""
    more = more.select(F.col("node").alias("old"), F.col("root").alias("new"))
    return of.join(more, F.col(name) == F.col("old"), "left").withColumn(name, F.coalesce("new", name)).drop("old", "new")


def alike(known: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (a line of its component) of the lines that are similar to another: components of all candidates that are."""
    keys = scratch.table(signed(known.select("h", "line")))
    rows = keys.select("h", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("in_bucket")).where("in_bucket > 1")
    members = scratch.table(rows.join(shared, "key"))
    texts = scratch.table(known.select("h", "line").join(members.select("h").distinct(), "h", "left_semi"))
    words = [f"w{k}" for k in range(WORDS)]
    sketches = scratch.table(sketched(texts)).select("h", F.struct("size", *words).alias("own"))
    release(known.sparkSession)
    # a line that shares many large buckets is near the middle of its group
    central = members.groupBy("h").agg(F.sum("in_bucket").alias("score"))
    lead = members.join(central, "h").groupBy("key").agg(F.min(F.struct(-F.col("score"), "h")).alias("least"))
    members = members.join(lead.select("key", F.col("least.h").alias("lead")), "key")
    members = scratch.table(members.select("key", "h", "lead", F.when(F.col("h") == F.col("lead"), 0).otherwise(turn(F.col("h"), F.col("in_bucket"))).alias("turn")))
    near = members.where("h != lead").select(F.least("lead", "h").alias("a"), F.greatest("lead", "h").alias("b")).distinct()
    near = near.join(sketches.select(F.col("h").alias("a"), F.col("own").alias("own_a")), "a")
    near = near.join(sketches.select(F.col("h").alias("b"), F.col("own").alias("own_b")), "b")
    of = components(cut(similar(near.where(may_be_similar("own_a", "own_b")).select("a", "b", *sizes()), texts).select("a", "b")))
    named = merged(merged(members.where("turn > 0").withColumns({"root": F.col("h"), "lead_root": F.col("lead")}).drop("lead"), of), of, "lead_root")
    # what is left of the buckets that no round is needed for goes here
    named = scratch.table(open_buckets(named))
    release(known.sparkSession)
    last = named.agg(F.max("turn")).first()[0] or 0
    for now in range(1, last + 1):
        found = cut(similar(meetings(named, sketches, now), texts).select("root_a", "root_b").distinct())
        more = components(found, "root_a", "root_b")
        of = merged(of, more).unionByName(more).distinct()
        release(of.sparkSession)
        if now < last:
            named = scratch.table(open_buckets(merged(merged(named.where(F.col("turn") > now), more), more, "lead_root")))
    return of


def linked_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """h, g and component (a line's h) of the lines that are not unique."""
    with Scratch(docs.sparkSession) as inner:
        known = inner.bucketed(distinct_lines(docs), "h")
        final = alike(known, inner).select(F.col("node").alias("h"), F.col("root").alias("component"))
        release(docs.sparkSession)
        whole = known.select("h", "g", "n").join(final, "h", "left").where("n > 1 or component is not null")
        return scratch.table(whole.select("h", "g", F.coalesce("component", "h").alias("component")))


def removed_lines(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_hash and drop (sorted numbers of the lines to remove), of documents that lose a line.

    ``rows`` are the :func:`occurrences` of ``docs``.
    """
    linked = linked_lines(docs, scratch)
    each = rows.select("doc_id", "text_hash", F.posexplode("lines").alias("line_no", "line")).where("line is not null")
    each = each.select("doc_id", "text_hash", "line_no", F.col("line.h").alias("h"), F.col("line.g").alias("own_g"))
    # hot lines come many times: the join's large side is one that Spark can split
    found = scratch.table(each.join(linked, "h").where("own_g = g").select("doc_id", "text_hash", "line_no", "component"))
    here = F.struct("doc_id", "text_hash", "line_no")
    stays = found.groupBy(F.col("component").alias("of")).agg(F.min(here).alias("stays"))
    gone = found.join(stays, F.col("component") == F.col("of")).where(~here.eqNullSafe(F.col("stays")))
    return gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("drop"))


def without_removed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (own, doc_id, text_hash) and drop, null where nothing goes."""
    gone = gone.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "drop")
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")


def drop_duplicate_lines(docs: DataFrame, emptied: bool = True) -> DataFrame:
    """``docs`` without the lines that repeat another.

    All columns stay; n_chars, if there is one, is counted anew where texts
    changed. Documents of which no line but blank ones is left go if ``emptied``
    is false and they have lost a line.
    """
    with Scratch(docs.sparkSession) as scratch:
        # read again by the result, so it outlives the others
        gone = table(removed_lines(docs.select("doc_id", "text"), scratch.table(occurrences(docs.select("doc_id", "text"))), scratch))
    # the caller's columns are one struct, so none of their names can clash
    rows = docs.select(F.struct("*").alias("own")).select("own", F.col("own.doc_id").alias("doc_id"), F.xxhash64("own.text").alias("text_hash"))
    out = without_removed(rows, gone)
    kept = F.filter(F.split("own.text", "\n", -1), lambda _, i: ~F.array_contains("drop", i))
    out = out.withColumn("text", F.when(F.col("drop").isNull(), F.col("own.text")).otherwise(F.array_join(kept, "\n")))
    if not emptied:
        out = out.where(F.col("drop").isNull() | (F.btrim("text", F.lit(" \t\r\n")) != ""))
    return with_new_text(out, docs, F.col("drop").isNotNull())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document how many lines go, and which (numbers from 0)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    with Scratch(spark) as scratch:
        rows = scratch.table(occurrences(docs))
        n_lines = F.coalesce(F.size("lines"), F.lit(0)).cast("long")
        out = without_removed(rows.select("doc_id", "text_hash", n_lines.alias("n_lines")), removed_lines(docs, rows, scratch))
        gone = F.coalesce("drop", F.array().cast("array<int>"))
        return table(out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed")))
