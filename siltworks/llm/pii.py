"""Personal data: fixed forms, and more by bootstrapped contextual extraction.

Four fixed forms (email, ip, card, phone) are found everywhere. They seed a
bootstrap: words before and after a seed make lexical patterns; patterns and the
identifiers beside which they stand make a bipartite graph, on which Spark scores
patterns by their instances and instances by their patterns, round by round.
Patterns of high confidence then mark identifiers of no fixed form (kind
``context``). DataFrame functions only.

Edge cases: a null or empty text has no span; texts of any length are searched
whole (the expressions use possessive loops, so long runs need no stack); spans
of different kinds may overlap; repeated rows get the same spans; rows with a
null doc_id are searched like others; an empty table gives no row; further
columns are ignored or, where documents are returned, left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import cut, read, with_new_text

_LOCAL, _WS = r"A-Za-z0-9._%+-", r"\x20\x09-\x0D"
#: Kinds in the order in which spans are told, and the expressions of the fixed ones.
#: They find what the plain forms find, but begin only where a run begins and never look back.
FIXED = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*FIXED, "context")
#: An identifier: a word with a digit, and the words of digits after it.
IDENTIFIER = rf"(?<![^{_WS}])[^{_WS}0-9]*+[0-9][^{_WS}]*+(?:\x20[()+.-]*+[0-9][0-9()+.-]*+(?![^{_WS}]))*+"
#: A pattern is trusted from this confidence, if so many distinct instances of that score support it; rounds of scoring.
CONFIDENCE, SUPPORT, ROUNDS = 0.9, 5, 4
#: In the documents where it stands beside an identifier, it does so for this share of its occurrences.
SPECIFIC = 0.5

_BLOCK = 256


def running(steps: Column) -> Column:
    """Running sums of an array, by sums of blocks before and of what precedes within the block."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluated once

    def blocks(s: Column) -> Column:
        last = F.floor((F.size(s) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))

    def upto(s: Column, sums: Column, i: Column) -> Column:
        b = F.floor(i / _BLOCK).cast("int")
        return total(F.slice(sums, F.lit(1), b)) + total(F.slice(s, b * _BLOCK + 1, i - b * _BLOCK + 1))

    return bound(steps, lambda s: bound(blocks(s), lambda sums: F.transform(s, lambda _, i: upto(s, sums, i))))


def parts(text: Column, pattern: str, guard: Column) -> Column:
    """The matches of ``pattern`` and the texts around them; null where ``guard`` says that there is none."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.when(guard, found)


def located(part: Column) -> Column:
    """[(text, start, end, before, after)] of the matches in ``part``; before and after are the texts up to the next match on either side."""
    steps = F.transform(part["m"], lambda _, i: F.length(F.get(part["p"], i)) + F.when(i > 0, F.length(F.get(part["m"], i - 1))).otherwise(0))
    spans = F.transform(
        F.arrays_zip(part["m"].alias("m"), part["p"].alias("p"), running(steps).alias("s")),
        lambda x, i: F.struct(
            x["m"].alias("text"), x["s"].alias("start"), (x["s"] + F.length(x["m"])).alias("end"), x["p"].alias("before"), F.get(part["p"], i + 1).alias("after")
        ),
    )
    none = F.array().cast("array<struct<text:string,start:int,end:int,before:string,after:string>>")
    return F.when(F.size(part["m"]) > 0, F.slice(spans, F.lit(1), F.size(part["m"]))).otherwise(none)


def luhn(text: Column) -> Column:
    digits = F.regexp_replace(text, "[ -]", "")
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return text.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.length(F.regexp_replace(text, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def named(kind: str) -> Column:
    """The valid spans of the column ``kind``, with their kind."""
    ok = F.filter(F.col(kind), lambda s: valid(kind, s["text"]))
    told = F.transform(ok, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.coalesce(told, F.array().cast("array<struct<kind:string,start:int,end:int>>"))


def of_kind(spans: str, kind: str) -> Column:
    """How many of ``spans`` are of ``kind``."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def fixed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, base (array of kind, start, end) and ids (identifiers with the words before), for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    guards = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][0-9 -]{11}"),
        "phone": F.contains(text, F.lit("+")),
    }
    cols = [parts(text, FIXED[k], guards[k]).alias(k) for k in FIXED]
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), *cols, parts(text, IDENTIFIER, text.rlike("[0-9]")).alias("ids"),
        F.when(text.rlike("[0-9]"), F.concat(F.lit(" "), F.regexp_replace(F.lower(text), rf"[{_WS}]+", "  "), F.lit(" "))).alias("plain"),
    )
    rows = rows.select("doc_id", "text_hash", "plain", *(F.when(F.col(k).isNotNull(), located(F.col(k))).alias(k) for k in (*FIXED, "ids")))
    spans = [named(k) for k in FIXED]
    ids = F.transform(
        F.col("ids"),
        lambda s: F.struct(
            near(s["before"], True).alias("left"),
            near(s["after"], False).alias("right"),
            F.regexp_replace(s["text"], r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "").alias("text"),
            (s["start"] + F.length(F.regexp_extract(s["text"], r"^[^\p{L}0-9+]+", 0))).alias("start"),
        ),
    )
    counted = F.transform(ids, lambda i: i.withField("again", F.transform(patterns(i), lambda p: times(F.col("plain"), F.substring(p, 3, F.length(p))))))
    none = F.array().cast("array<struct<left:array<string>,right:array<string>,text:string,start:int,again:array<int>>>")
    return rows.select("doc_id", "text_hash", F.concat(*spans).alias("base"), F.coalesce(counted, none).alias("ids"))


def near(text: Column, last: bool) -> Column:
    """The last or first two words of ``text`` (one, if there is one), of whatever length, in lower case."""
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluated once
    each = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), rf"[{_WS}]+", -1), lambda w: w != "")
    return bound(each, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)) if last else F.lit(1), F.lit(2)))


def patterns(i: Column) -> Column:
    """The patterns of an identifier: the word before it and the two before it, the word after it and the two after it.

    A pattern is its side, < or >, and its words, parted by one space; null where there are too few.
    """

    def of(side: str, words: Column, one: Column) -> list[Column]:
        return [F.concat(F.lit(side), one), F.when(F.size(words) == 2, F.concat(F.lit(side), F.array_join(words, " ")))]

    left, right = i["left"], i["right"]
    return F.array(*of("< ", left, F.get(left, F.size(left) - 1)), *of("> ", right, F.get(right, F.lit(0))))


def times(plain: Column, pattern: Column) -> Column:
    """How often ``pattern`` stands in ``plain``, of whose words each has a space on both sides."""
    token = F.concat(F.lit(" "), F.replace(pattern, F.lit(" "), F.lit("  ")), F.lit(" "))
    left = F.length(F.replace(plain, token, F.lit("")))
    return F.when(pattern == "", 0).otherwise(((F.length(plain) - left) / F.length(token)).cast("int"))


def occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, pattern, instance, seed, start, end: every identifier under each of its patterns."""
    one = rows.where(F.size("ids") > 0).select("doc_id", "text_hash", "base", F.explode("ids").alias("i"))
    end = F.col("i.start") + F.length("i.text")
    seed = F.exists("base", lambda b: (b["start"] < end) & (b["end"] > F.col("i.start")))
    both = F.arrays_zip(patterns(F.col("i")).alias("pattern"), F.col("i.again").alias("again"))
    out = one.select(
        "doc_id", "text_hash", F.xxhash64("i.text").alias("instance"), seed.alias("seed"),
        F.col("i.start").alias("start"), end.alias("end"), F.inline(both),
    )
    return out.where("pattern is not null")


def trusted_patterns(found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """pattern and confidence of the patterns that the bootstrap trusts.

    A pattern's confidence is the mean score of its distinct instances; an
    instance's score is 1 if it is a seed, else the chance that one of its
    half-trusted patterns is right. A pattern takes ``support`` instances that reach
    ``confidence`` without it: seeds in the first round, later also instances that
    other patterns vouch for.
    """
    uses = found.groupBy("pattern", "doc_id", "text_hash").agg(F.countDistinct("start").alias("k"), F.max("again").alias("again"))
    uses = uses.groupBy("pattern").agg((F.sum("k") / F.sum(F.greatest("k", "again"))).alias("specific")).where(F.col("specific") >= SPECIFIC)
    edges = found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    fit = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support)
    edges = cut(edges.join(fit.select("pattern"), "pattern").join(uses.select("pattern"), "pattern"))
    scored = edges.select("pattern", "instance", "seed", *(F.col("seed").cast("double").alias(c) for c in ("score", "alone")))
    for left in range(rounds, 0, -1):
        scores = scored.groupBy("pattern").agg(
            F.avg("score").alias("confidence"), F.count_if(F.col("alone") >= confidence).alias("sure")
        )
        if left == 1:
            return scores.where((F.col("confidence") >= confidence) & (F.col("sure") >= support)).select("pattern", "confidence")
        wrong = F.when(F.col("confidence") >= 0.5, F.log1p(-F.least("confidence", F.lit(0.999)))).otherwise(0.0)
        each = edges.join(scores, "pattern").select("pattern", "instance", "seed", wrong.alias("wrong"))
        told = each.join(each.groupBy("instance").agg(F.sum("wrong").alias("all_wrong")), "instance")
        chance = lambda c: F.when(F.col("seed"), 1.0).otherwise(1 - F.exp(c))
        score, alone = chance(F.col("all_wrong")), chance(F.col("all_wrong") - F.col("wrong"))
        scored = cut(told.select("pattern", "instance", "seed", score.alias("score"), alone.alias("alone")))


def find_pii(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of kind, start, end in code points) for every row of ``docs``."""
    rows = cut(fixed_spans(docs))
    found = occurrences(rows)
    new = found.where(~F.col("seed")).join(trusted_patterns(found, **limits), "pattern")
    span = F.struct(F.lit("context").alias("kind"), "start", "end")
    new = new.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash")).agg(F.sort_array(F.collect_set(span)).alias("more"))
    on = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash"))
    out = rows.join(new, on, "left")
    return out.select("doc_id", "text_hash", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def redact(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; of overlapping spans the first one gives the name.

    All columns stay; n_chars, if there is one, is counted anew where texts changed.
    """
    found = find_pii(docs.select("doc_id", "text"), **limits).where(F.size("spans") > 0)
    found = found.groupBy("doc_id", "text_hash").agg(F.first("spans").alias("spans"))
    # the caller's columns are one struct, so none of their names can clash
    own = docs.select(F.struct("*").alias("own"))
    text = F.col("own.text")
    on = F.col("own.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("text_hash"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, s: Column) -> Column:
        kept = F.concat(state["done"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], kept).otherwise(state["done"]).alias("done"),
        )

    end = F.aggregate(order, start, step, lambda x: F.concat(x["done"], F.substring(text, x["at"] + 1, F.length(text))))
    out = own.join(found, on, "left").withColumn("text", F.when(F.col("spans").isNull(), text).otherwise(end))
    return with_new_text(out, docs, F.col("spans").isNotNull())


def op10_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of every document."""
    found = find_pii(read(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [of_kind("base", k).alias(f"n_{k}") for k in FIXED]
    return found.select("doc_id", *counts, F.sha2(told("base"), 256).alias("base_sha256"), told("spans").alias("spans"))
