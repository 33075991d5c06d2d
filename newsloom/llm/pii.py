"""PII by weak supervision, as DataFrame operations only.

Base spans (e-mail, IP address, card and phone number) are fixed patterns with
checks.  The method adds spans of kinds that no single pattern settles: loose
patterns propose candidates (``secret``: long mixed tokens; ``ssn``: grouped
ids; ``person``: capitalised pairs after a form of address), and regex,
gazetteer and context labelers vote for, against or not at all; every kind has
labelers that can say either.  Votes are counted by pattern over the whole corpus
(at most 3 ** 8 patterns times 20 classes of features a kind, whatever its size);
expectation-maximisation on that table estimates each labeler's reliability and
the prior, and with the resulting soft labels the final classifier is trained:
naive Bayes over the votes and the candidate's own length (four classes) and place
(what stands before it), kept as a table of log-odds and applied as one expression.

Patterns that repeat a group do so possessively, since Java matches such a group
otherwise by recursion and long texts of digits would end the JVM; no match
changes by that, because nothing follows the group.

Everything a document needs is in its row: no shuffle but that of the counts.

Edge cases: a null or empty text has no spans; very long texts cost time in
proportion to their length; repeated rows are separate rows; an empty table
gives an empty result (no votes, so the classifier stays at its priors); columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

# Base patterns; a run of class characters is tried from its start only (\G: or where the previous match ended), which finds
# the same leftmost matches and keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE_KINDS = ("email", "ip", "card", "phone")

# Candidate patterns of the added kinds.
CANDIDATES = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señor|Señora)\.? [A-Z][a-zà-ÿ]+ [A-Z][a-zà-ÿ]+",
}
ADDED_KINDS = tuple(CANDIDATES)

# Gazetteers, fixed values.
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "ya29", "eyJ", "SG-", "hf_", "npm_")
GIVEN_NAMES = ("James", "Mary", "John", "Linda", "Robert", "Anna", "Michael", "Maria", "David", "Laura", "Thomas", "Julia", "Peter", "Sophie", "Paul", "Claire", "Hans", "Petra", "Klaus", "Ursula", "Jean", "Marie", "Pierre", "Camille", "José", "Carmen", "Juan", "Lucía", "Carlos", "Elena")
NOT_NAMES = (
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Monday", "Tuesday", "Wednesday", "Thursday",
    "Friday", "Saturday", "Sunday", "North", "South", "East", "West", "New", "Saint", "Royal", "National", "United", "International", "General", "Great", "Central", "The",
)
NOT_SURNAMES = (
    "Street", "Road", "Avenue", "Square", "University", "College", "School", "Hospital", "Award", "Prize", "Museum", "Park", "Bridge", "Station", "Company", "Limited", "Group",
    "Bank", "Church", "Airport", "Island", "River", "County", "Who", "Strange", "Pepper", "Bean", "Watson", "Robot",
)
SURNAME_ENDS = ("son", "sen", "man", "mann", "berg", "stein", "ski", "sky", "ova", "ov", "ez", "er", "ford", "ton", "ley", "field", "wood", "bauer", "meier", "schmidt", "ier", "ard", "eau", "ith", "nes", "own", "ark")
FAKE_SSN = ("123-45-6789", "078-05-1120", "219-09-9999", "111-11-1111", "987-65-4321")
CONTEXT_BEFORE = 32
CONTEXT_AFTER = 16
SECRET_WORDS = r"(?i)(?:token|secret|passw|pwd|api|key|auth|bearer|credential)"
SECRET_NOT = r"(?i)\b(?:commit|sha[0-9]*|md5|checksum|digest|version|uuid|isbn|file|page|section|figure|chapter|route|slug|class|anchor)\W*$"
SSN_WORDS = r"(?i)(?:\bssn|social security|tax ?id|taxpayer|patient|employee|identity|benefit)"
SSN_NOT = r"(?i)\b(?:phone|tel|fax|call|order|invoice|isbn|part|item|model|serial|score|version|room|lot|ref(?:erence)?)\W*(?:no|number|#)?\W*$"
PERSON_WORDS = r"(?i)(?:patient|customer|contact|client|name|dear|attn|signed|sincerely|regards|resident|tenant|applicant)"
PERSON_NOT = r"(?i)\b(?:the|a|an|of the|film|movie|novel|book|song|series|character|at|on)\s*$"

BLOCK = 256


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """What fold makes, from 0, of all values before each one of an int array; in two levels, so long arrays cost n * BLOCK at most."""
    over = lambda xs: F.aggregate(xs, F.lit(0), fold)

    def of(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), (F.size(xs) / BLOCK).cast("int")), lambda k: over(F.slice(xs, k * BLOCK + 1, BLOCK)))

        def within(first: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                k = (i / BLOCK).cast("int")
                return fold(F.get(first, k), over(F.slice(xs, k * BLOCK + 1, i - k * BLOCK)))

            return F.transform(xs, one)

        return let(let(blocks, lambda tops: F.transform(tops, lambda _, k: over(F.slice(tops, F.lit(1), k)))), within)

    return let(values, of)


def find_spans(text: Column, pattern: str, needs: Column, good=None) -> Column:
    """array<struct<s, e, m>> of the pattern's matches in code points; needs: a cheap test that must hold for any match."""

    def placed(gaps: Column, found: Column) -> Column:
        sizes = F.zip_with(gaps, found, lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))

        def at(ends: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(ends, i) + F.get(gaps, i)
                return F.struct(start.alias("s"), (start + F.length(m)).alias("e"), m.alias("m"))

            return F.transform(found, one)

        return let(running(sizes, lambda a, x: a + x), at)

    def all_of(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        return F.when(F.size(found) > 0, let(gaps, lambda g: placed(g, found)))

    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    spans = F.coalesce(F.when(needs, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), all_of)), empty)
    return spans if good is None else F.filter(spans, lambda x: good(x["m"]))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def ip_ok(m: Column) -> Column:
    small = lambda p: (F.length(p) <= 3) & (F.coalesce(F.nullif(p, F.lit("")).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(m, r"\."), lambda x: small(F.regexp_replace(x, "^0+", "")))


def luhn_ok(m: Column) -> Column:
    def total(d: Column) -> Column:
        value = lambda i: F.ascii(F.substring(d, F.length(d) - i, 1)) - 48
        term = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), term), F.lit(0), lambda a, x: a + x) % 10 == 0

    return F.when(F.length(digits(m)).between(16, 19), let(digits(m), total)).otherwise(F.lit(False))


def phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": find_spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": find_spans(text, IP, text.rlike(r"[0-9]\.[0-9]"), ip_ok),
        "card": find_spans(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9]"), luhn_ok),
        "phone": find_spans(text, PHONE, F.contains(text, F.lit("+")), phone_ok),
    }


#: Labelers: what each says (1 for, 0 against, -1 not at all) of a match m with some text before and after it.
def votes(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else F.lit(False), 0).otherwise(-1)
    against = lambda no: F.when(no, 0).otherwise(-1)
    one_of = lambda words: "(?:" + "|".join(w.replace("-", r"\-") for w in words) + ")"
    # Parts of a path, a host, an address or a file name; a full stop that ends a sentence is none.
    part = before.rlike(r"[/.@+~\\#%]$") | after.rlike(r"^(?:[/@+\\]|\.[A-Za-z0-9])")
    inside = against(part)
    assigned = before.rlike(r"[=:]\s*[\"']?$") | before.rlike("[\"']$")
    distinct = F.size(F.array_distinct(F.split(F.substring(m, 1, 256), "")))
    n_digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "secret":
        return [
            vote(m.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^[0-9a-f]{32,}$|^(?:gh[pousr]_|glpat-|sk[-_]|xox[a-z]-)[A-Za-z0-9_-]{12,}$"), m.rlike(r"^[A-Za-z]+[-_][A-Za-z]+|^[A-Za-z]+[0-9]{1,4}$|^[0-9-]+[a-z]{1,3}$")),
            # Digits and length are common in names of pages and files, and speak for a secret elsewhere only.
            vote(~part & (n_digits >= 4), n_digits < 3),
            vote(m.rlike("^" + one_of(SECRET_PREFIXES)), m.rlike("^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|v[0-9]|[A-Za-z]+-[A-Za-z]+-)")),
            vote(before.rlike(SECRET_WORDS), before.rlike(SECRET_NOT)),
            vote(assigned, before.rlike("[A-Za-z] $") & after.rlike("^ [a-z]")),
            vote(~part & (F.length(m) >= 32), F.length(m) > 512),
            vote(~part & (distinct >= 11), distinct < 8),
            inside,
        ]
    if kind == "ssn":
        valid = ~m.rlike("^(?:000|666|9)|-00-|-0000$")
        return [
            vote(valid, ~valid),
            vote(before.rlike(r"(?i)(?:\bssn|social security|tax ?id|taxpayer)"), before.rlike(SSN_NOT)),
            against(m.isin(*FAKE_SSN) | (distinct <= 2)),
            vote(before.rlike(SSN_WORDS), before.rlike(r"(?i)(?:example|sample|dummy|test|placeholder)\W*$")),
            vote(before.rlike("[=:#]\\s*[\"']?$"), before.rlike("[A-Za-z0-9]$")),
            vote(after.rlike(r"^(?:$|[\s,.;)\"'])"), after.rlike("^[A-Za-z]")),
            vote(before.rlike(r"(?:^|[\s:(\"'#])$") & (distinct >= 5), before.rlike(r"[$€£]\s*$") | after.rlike(r"^\s*(?:%|kg|km|USD|EUR)")),
            inside,
        ]
    first, last = F.regexp_extract(m, r"^\S+ (\S+) ", 1), F.regexp_extract(m, r" (\S+)$", 1)
    return [
        vote(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\. |^(?:Herr|Frau|Mme|Señor|Señora) "), first == last),
        vote(first.rlike("^" + one_of(GIVEN_NAMES) + "$"), first.rlike("^" + one_of(NOT_NAMES) + "$")),
        vote(last.rlike(one_of(SURNAME_ENDS) + "$"), last.rlike("^" + one_of(NOT_SURNAMES) + "$")),
        vote(before.rlike(PERSON_WORDS), before.rlike(PERSON_NOT)),
        vote(before.rlike(r"(?i)\b(?:by|from|with|for|to|and|asked|told|met|called|says|said)[:,]?\s*$"), before.rlike("[A-Z]\\S* $")),
        vote(after.rlike(r"^(?:$|'s\b|[,.;:!?)]|\s+(?:said|says|wrote|told|called|lives|was|is|has|will)\b)"), after.rlike("^(?:[A-Za-z0-9_-]| [A-Z])")),
        vote(F.length(m).between(10, 32), F.length(m) > 48),
        inside,
    ]


N_LABELERS = 8
#: A part of a path, a host or a file name is seldom a true span: the last labeler starts with more trust than the others.
INSIDE_TRUST = 0.95


def features(m: Column, before: Column) -> list[Column]:
    """Length and place of a candidate, one character each; labelers look at its mix of characters."""
    n = F.length(m)
    size = F.when(n < 20, "a").when(n < 32, "b").when(n < 64, "c").otherwise("d")
    place = F.when(before.rlike(r"(?:^|\s)$"), "s").when(before.rlike("[\"'`]$"), "q").when(before.rlike("[=:]$"), "e").when(before.rlike(r"[/.@+~\\#%]$"), "p").otherwise("o")
    return [size, place]


#: Values of each position of a candidate's code: the votes, then the features.
ALPHABETS = ["10-"] * N_LABELERS + ["abcd", "sqepo"]


def candidates(text: Column) -> Column:
    """array<struct<kind, s, e, v>> of the candidates of every added kind; v: the votes, then the features, one character each."""
    needs = {"secret": text.rlike("[A-Za-z0-9_-]{16}"), "ssn": text.rlike("[0-9]-[0-9]{2}-[0-9]"), "person": text.rlike("(?:M(?:rs?|s|me)|Dr|Prof|Herr|Frau|Señor)")}

    def voted(kind: str) -> Column:
        def one(x: Column) -> Column:
            start = F.greatest(x["s"] - CONTEXT_BEFORE, F.lit(0))
            before, after = F.substring(text, start + 1, x["s"] - start), F.substring(text, x["e"] + 1, F.lit(CONTEXT_AFTER))
            code = F.concat(*[F.when(v == 1, "1").when(v == 0, "0").otherwise("-") for v in votes(kind, x["m"], before, after)], *features(x["m"], before))
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), code.alias("v"))

        return F.transform(find_spans(text, CANDIDATES[kind], needs[kind]), one)

    return F.concat(*[voted(kind) for kind in ADDED_KINDS])


def fit_reliabilities(counts: dict[str, int], rounds: int = 50, prior: float = 0.5, trust: float = 0.8, weight: float = 20.0) -> tuple[float, list[float], list[float], dict[str, float]]:
    """EM over vote patterns: prior of a true span, each labeler's rate of voting "1" given true and given false, and the
    soft label of each pattern.  Beta priors (``weight`` votes at ``trust``) keep rare labelers near their start."""
    trusts = [trust] * (N_LABELERS - 1) + [INSIDE_TRUST]
    share, true, false = prior, list(trusts), [1 - x for x in trusts]

    def posterior(v: str) -> float:
        odds = math.log(share / (1 - share))
        for j, x in enumerate(v[:N_LABELERS]):
            if x != "-":
                odds += math.log(true[j] / false[j]) if x == "1" else math.log((1 - true[j]) / (1 - false[j]))
        return 1 / (1 + math.exp(-max(-500, min(500, odds))))

    for _ in range(rounds):
        soft = {v: posterior(v) for v in counts}
        for j in range(N_LABELERS):
            said = [(v[j], n, soft[v]) for v, n in counts.items() if v[j] != "-"]
            true[j] = (trusts[j] * weight + sum(n * p for x, n, p in said if x == "1")) / (weight + sum(n * p for _, n, p in said))
            false[j] = ((1 - trusts[j]) * weight + sum(n * (1 - p) for x, n, p in said if x == "1")) / (weight + sum(n * (1 - p) for _, n, p in said))
        total = sum(counts.values())
        share = (weight * prior + sum(n * soft[v] for v, n in counts.items())) / (weight + total)
    return share, true, false, {v: posterior(v) for v in counts}


def train_classifier(counts: dict[str, int], soft: dict[str, float], share: float) -> tuple[float, dict[tuple[int, str], float]]:
    """Naive Bayes from soft labels: bias and weight of each (labeler, vote) and (feature, value); abstaining is a value of its own."""
    yes = sum(n * soft[v] for v, n in counts.items())
    no = sum(counts.values()) - yes
    weights = {}
    for j, values in enumerate(ALPHABETS):
        for x in values:
            start = {"1": (0.8, 0.2), "0": (0.2, 0.8), "-": (0.5, 0.5)}.get(x, (1 / len(values), 1 / len(values)))
            t = sum(n * soft[v] for v, n in counts.items() if v[j] == x)
            f = sum(n * (1 - soft[v]) for v, n in counts.items() if v[j] == x)
            weights[j, x] = math.log((t + 20 * start[0]) / (yes + 20)) - math.log((f + 20 * start[1]) / (no + 20))
    return math.log(share / (1 - share)), weights


def fit(docs: DataFrame) -> dict[str, tuple[float, dict[tuple[int, str], float]]]:
    """The span classifier of each added kind, from the votes over all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.explode(candidates(text)).alias("c")).groupBy("c.kind", "c.v").agg(F.count("*").alias("n"))
    counts: dict[str, dict[str, int]] = {k: {} for k in ADDED_KINDS}
    for r in found.collect():  # at most 3 ** N_LABELERS * 20 rows a kind
        counts[r.kind][r.v] = r.n
    model = {}
    for kind, table in counts.items():
        share, _, _, soft = fit_reliabilities(table)
        model[kind] = train_classifier(table, soft, share)
    return model


def accepted(model: dict, c: Column) -> Column:
    """Whether the classifier's log-odds of a candidate are above zero."""
    test = F.lit(False)
    for kind, (bias, weights) in model.items():
        odds = F.lit(bias)
        for j, values in enumerate(ALPHABETS):
            x, *rest = values
            said = F.substring(c["v"], j + 1, 1)
            weight = F.when(said == x, weights[j, x])
            for x in rest:
                weight = weight.when(said == x, weights[j, x])
            odds = odds + weight
        test = F.when(c["kind"] == kind, odds > 0).otherwise(test)
    return test


def with_spans(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """docs with pii_base (struct of the four kinds' spans) and pii_added (array of accepted candidates); docs has no such columns."""
    model = fit(docs) if model is None else model
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.struct(*[c.alias(k) for k, c in base_spans(text).items()])
    return docs.withColumn("pii_base", base).withColumn("pii_added", F.filter(candidates(text), lambda c: accepted(model, c)))


def _said(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    d = with_spans(docs.select("doc_id", "text"))
    base = F.concat(*[_said(F.col("pii_base")[k], k) for k in BASE_KINDS])
    of_kind = lambda k: F.filter("pii_added", lambda c: c["kind"] == k)
    added = F.concat(*[_said(of_kind(k), k) for k in ADDED_KINDS])
    return d.select(
        "doc_id",
        *[F.size(F.col("pii_base")[k]).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, added), ",").alias("spans"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by <KIND>; columns unchanged, whatever their names, a null text stays null."""
    names = docs.columns
    carried = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("__none")).alias("carried"))
    d = with_spans(carried)
    tagged = lambda k: F.transform(F.col("pii_base")[k], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{k.upper()}>").alias("r")))
    flat = F.concat(
        *[tagged(k) for k in BASE_KINDS],
        F.transform("pii_added", lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.concat(F.lit("<"), F.upper(c["kind"]), F.lit(">")).alias("r"))),
    )

    def cut(spans: Column) -> Column:
        # Spans of different kinds may overlap: one begins where the furthest end before it lies.
        reach = running(F.transform(spans, lambda x: x["e"]), lambda a, x: F.greatest(a, x))

        def pieces(ends: Column) -> Column:
            before = lambda x, i: F.substring(F.col("text"), F.get(ends, i) + 1, F.greatest(x["s"] - F.get(ends, i), F.lit(0)))
            shown = lambda x, i: F.concat(before(x, i), F.when(x["s"] >= F.get(ends, i), x["r"]).otherwise(F.lit("")))
            whole = F.aggregate(spans, F.lit(0), lambda a, x: F.greatest(a, x["e"]))
            tail = let(whole, lambda w: F.substring(F.col("text"), w + 1, F.length("text")))
            return F.concat(F.array_join(F.transform(spans, shown), ""), tail)

        return let(reach, pieces)

    masked = F.when(F.size("pii_spans") > 0, let(F.col("pii_spans"), cut)).otherwise(F.col("text"))
    done = d.withColumn("pii_spans", F.sort_array(flat)).withColumn("text", masked)
    return done.select(*[F.col("text") if c == "text" else F.col("carried")[c].alias(c) for c in names])
