import random
import re

from siltworks.llm import pii
from tests.llm.helpers import documents, words

FORMS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in FORMS for m in re.finditer(p, text or "") if good(k, m[0])]


def base(spark, texts):
    rows = pii.find_pii(documents(spark, texts)).collect()
    return {r.doc_id: [tuple(s) for s in r.base] for r in rows}


def test_fixed_forms_by_brute_force(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "b", "-", "_", "1", "4111111111111111", " ", "+", "(", "2", "é", "😀", "0", "9", "\n"]
    texts = [
        None, "", "a@b.c_d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.255 1.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1111-", "12 4111111111111111",
        "4111111111111111 2", "+1 (017) 555-7713 +44", "++1 2345678 90", "x" * 1500, "1" * 1500, "1 " * 900, "a@" * 900, "a@b." * 900, "a@b" + ".c" * 900, "+1" + "(" * 900, "1." * 900,
        "😀 é 4111111111111111 a@b.co", "a.b@c.d " * 700,
    ]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 70))) for _ in range(600)]
    assert base(spark, texts) == {i: plain(t) for i, t in enumerate(texts)}


def test_very_long_runs_need_no_stack(spark):
    texts = ["1" * 300_000, "1 " * 150_000, "a@b" + ".c" * 150_000, "a@" * 150_000, "1." * 50_000]
    assert {i: len(s) for i, s in base(spark, texts).items()} == {0: 0, 1: 0, 2: 1, 3: 0, 4: 12_500}


def card(rng):
    d = "".join(str(rng.randint(0, 9)) for _ in range(15))
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def test_contexts_find_unseen_identifiers_and_redaction(spark):
    rng = random.Random(1)
    texts = [f"please use card {rng.randint(100000, 999999)}x now" for _ in range(3)]
    texts += [f"the card {card(rng)} was charged in {1000 + i} days" for i in range(40)]
    texts += [f"in {1000 + i} days the end" for i in range(5)] + [None, "", "no data"]
    docs = documents(spark, texts)
    out = pii.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[0] == "please use card [CONTEXT] now"
    assert rows[3] == "the card [CARD] was charged in 1000 days"
    assert rows[43] == texts[43] and rows[48] is None and rows[49] == "" and rows[50] == "no data"


def redacted(spark, texts):
    rows = {r.doc_id: r.text for r in pii.redact(documents(spark, texts)).collect()}
    return [rows[i] for i in range(len(texts))]


def test_a_pattern_of_two_words_is_held_against_its_own_occurrences(spark):
    seeds = [f"write  me at u{i}@mail.example or look at it at home at night" for i in range(30)]
    # "to at" stands often before words without a digit, so it is no context; neither is "at"
    other = [f"write to at v{i}@mail.example to at home to at night" for i in range(30)]
    out = redacted(spark, [*seeds, *other, "write me at 77318x or look at it", "write to at 77318x when home"])
    assert out[-2:] == ["write me at [CONTEXT] or look at it", "write to at 77318x when home"]


def test_five_seeds_are_enough_and_four_are_not(spark):
    # what follows them is different each time, so that only the words before can tell
    five = [f"contact u{i}@mail.example {words(i, 2)}" for i in range(5)]
    four = [f"ask v{i}@mail.example {words(10 + i, 2)}" for i in range(4)]
    assert redacted(spark, [*five, *four, "contact 77318x please", "ask 88429x please"])[-2:] == ["contact [CONTEXT] please", "ask 88429x please"]


def test_identifiers_of_few_digits_are_drawn_by_their_context(spark):
    texts = [f"contact u{i}@mail.example please" for i in range(30)] + ["contact jo7 please", "in 7 days"]
    assert redacted(spark, texts)[-2:] == ["contact [CONTEXT] please", "in 7 days"]


def test_identifiers_that_one_pattern_finds_support_another(spark):
    # no seed ever stands after "ticket": it is learnt from codes that "contact" vouches for
    codes = [f"AB{1000 + i}x" for i in range(8)]
    texts = [f"contact u{i}@mail.example please" for i in range(30)]
    texts += [f"{word} {code} then" for code in codes for word in ("contact", "ticket")] + ["ticket 77318x then", "in 77 days then"]
    docs = documents(spark, texts)
    last = lambda **k: [r.text for r in pii.redact(docs, **k).where("doc_id >= 46").orderBy("doc_id").collect()]
    assert last() == ["ticket [CONTEXT] then", "in 77 days then"]
    assert last(rounds=1) == ["ticket 77318x then", "in 77 days then"]


def test_the_words_before_are_found_at_any_distance(spark):
    texts = [f"account  number\n u{i}@mail.example {words(i, 2)}" for i in range(12)]
    far = ["account number" + " " * n + "77318x end" for n in (1, 90, 5000)] + ["account number " + "w" * 3000 + " 77318x end"]
    out = redacted(spark, [*texts, *far])
    assert [t.rsplit(" ", 2)[1] for t in out[-4:]] == ["[CONTEXT]"] * 3 + ["77318x"]


def test_words_after_are_contexts_too(spark):
    """Ten addresses under ten different words, all followed by the same ones."""
    texts = [f"{words(i, 2)} u{i}@mail.example is my address {words(50 + i, 3)}" for i in range(10)]
    out = redacted(spark, [*texts, "qqq 77318x is my address", "qqq 77318x was mine", "in 7 days"])
    assert out[-3:] == ["qqq [CONTEXT] is my address", "qqq 77318x was mine", "in 7 days"]


def test_precision_and_recall_on_paraphrased_contexts(spark):
    """Accounts of no fixed form stand in ways that addresses stand in too, among as many numbers that tell nobody."""
    rng = random.Random(9)
    ways = ["reach me under {} any time", "my handle is {} there", "{} belongs to me alone", "forward it to {} today", "signed in as {} yesterday"]
    other = ["in {} days", "about {} people came", "page {} of the book", "chapter {} ends", "it cost {} coins"]
    code = lambda: "".join(rng.choice("abcdefgh") for _ in range(4)) + str(rng.randint(100, 999))
    texts = [words(i, 6) + " " + ways[i % 5].format(f"u{i}@mail.example") + " " + words(1000 + i, 6) for i in range(60)]
    hidden = [words(2000 + i, 6) + " " + ways[i % 5].format(code()) + " " + words(3000 + i, 6) for i in range(50)]
    plain_ones = [words(4000 + i, 6) + " " + other[i % 5].format(rng.randint(2, 999)) + " " + words(5000 + i, 6) for i in range(60)]
    out = redacted(spark, [*texts, *hidden, *plain_ones])
    found = ["[CONTEXT]" in t for t in out[60:]]
    assert sum(found[:50]) >= 48 and not any(found[50:])


def test_overlaps_repeated_rows_null_ids_and_empty_table(spark):
    texts = ["me@a.co 1.2.3.4 no. 4111111111111111"] * 3 + [None]
    docs = documents(spark, texts, ids=[1, 1, None, None])
    rows = pii.redact(docs).collect()
    assert len(rows) == 4 and {r.text for r in rows} == {"[EMAIL] [IP] no. [CARD]", None}
    assert pii.redact(docs.where("false")).count() == 0
    assert pii.find_pii(docs.where("false")).count() == 0


def test_the_main_path_runs_no_python(spark):
    assert "Python" not in pii.redact(documents(spark, ["a@b.co"]))._jdf.queryExecution().toString()
