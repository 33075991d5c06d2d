"""Added spans against planted ones; texts that break recursive patterns; many and overlapping spans."""

import hashlib
import random

from newsloom.llm import pii

from . import brute

FIRST = ("Anna", "James", "Marko", "Petra", "Yusuf", "Claire", "Otto", "Lucía")
LAST = ("Johnson", "Keller", "Petrov", "Miller", "Okafor", "Berg", "Navarro", "Whitfield")


def planted(n=400, seed=4):
    """Texts with one true or false candidate each: (doc_id, text, kind, start, end, true)."""
    r = random.Random(seed)
    code = lambda k: "".join(r.choice("abcdefghijkmnpqrstuvwxyz23456789ABCDEFGHJK") for _ in range(k)) + "7x"
    out = []
    for i in range(n):
        true, kind = r.random() < 0.5, r.choice(("secret", "ssn", "person"))
        if kind == "secret":
            what = code(r.randint(22, 38)) if true else f"report-{r.choice(FIRST).lower()}-final-{r.randint(1, 9)}"
            before, after = (r.choice(("api_key = \"", "token: ", "password=")), " was leaked.") if true else (r.choice(("see https://x.org/", "open files/")), "/index for more.")
        elif kind == "ssn":
            what = f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if true else f"{r.choice(('000', '666', '987'))}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
            before, after = (r.choice(("her SSN: ", "social security number ", "taxpayer id ")), ", as filed.") if true else (r.choice(("order no. ", "part number ", "item ")), "b is gone.")
        else:
            what = f"{r.choice(('Mr.', 'Mrs.', 'Dr.'))} {r.choice(FIRST)} {r.choice(LAST)}" if true else f"{r.choice(('Mr', 'Dr'))} {r.choice(('North', 'Royal', 'Great', 'The'))} {r.choice(('Street', 'Hospital', 'Award', 'Bridge'))}"
            before, after = (r.choice(("a letter from ", "we told ", "dear ")), ", who agreed.") if true else (r.choice(("the ", "a ")), " Hall is shut.")
        out.append((i, f"It says that {before}{what}{after}", kind, 13 + len(before), 13 + len(before) + len(what), true))
    return out


def test_added_spans_of_planted_texts(spark):
    docs = planted()
    got = pii.find_pii(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()
    spans = {r.doc_id: {x for x in r.spans.split(",") if x.split(":")[0] in pii.ADDED_KINDS} for r in got}
    want = {i: {f"{kind}:{a}:{b}"} if true else set() for i, _, kind, a, b, true in docs}
    hit = sum(len(spans[i] & w) for i, w in want.items())
    assert hit >= 0.95 * sum(map(len, want.values()))
    assert hit >= 0.95 * sum(map(len, spans.values()))


def runs(n):
    """Digits, dots, brackets, parts of a host or characters of a token, over and over; plain patterns take quadratic time on some."""
    return ["7" * n, "1 " * (n // 2), "1." * (n // 2), "a@b" + ".c" * (n // 2), "+1" + "(" * n, "a" * n + "1", "1-" * (n // 2), "x@" * (n // 2), "4111 1111 1111 1111 " * (n // 50), "192.168.0.1 " * (n // 50)]


def test_runs_against_brute_force(spark):
    docs = list(enumerate(runs(2000)))
    got = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(brute.base_pii(docs))


def test_runs_of_a_million(spark):
    n = 1_000_000
    docs = spark.createDataFrame(list(enumerate(runs(n))), "doc_id long, text string").repartition(8)
    got = {r.doc_id: tuple(r)[1:5] for r in pii.find_pii(docs).collect()}
    found = {2: (0, n // 8, 0, 0), 3: (1, 0, 0, 0), 9: (0, n // 50, 0, 0)}
    assert got == {i: found.get(i, (0, 0, 0, 0)) for i in range(10)}


def test_masks_many_and_overlapping_spans(spark):
    many = " ".join(f"u{i}@example.org" for i in range(3000))
    texts = [many, "call +1 234 567 8901 or +49 30 1234567 now", "192.168.0.1 and 4111 1111 1111 1111", None, ""]
    got = {r.doc_id: r.text for r in pii.mask_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == " ".join(["<EMAIL>"] * 3000)
    assert got[1] == "call <PHONE> or <PHONE> now" and got[2] == "<IP> and <CARD>" and got[3] is None and got[4] == ""


def test_spans_column(spark):
    """Clashing columns, nulls and repeated rows change nothing, and the digest is that of the base spans."""
    docs = [(1, "mail a@b.co", "x", 5), (1, "mail a@b.co", "x", 5), (None, None, None, None)]
    got = pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string, spans string, n_email int")).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.n_email, r.base_sha256, r.spans) for r in got) == [(0, 0, digest(""), ""), *[(1, 1, digest("email:5:11"), "email:5:11")] * 2]


def test_mask_leaves_other_columns_alone(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de now", "x", "y", 3, "dot"), (2, None, None, None, None, None)], "doc_id long, text string, pii_base string, pii_spans string, pii_added int, `a.b` string")
    got = pii.mask_pii(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [(1, "mail <EMAIL> now", "x", "y", 3, "dot"), (2, None, None, None, None, None)]
