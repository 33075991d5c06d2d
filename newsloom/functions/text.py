"""Text functions as Column expressions: cleaning, fingerprints, keyword tests."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


#: White space of ASCII, ideographic and no-break spaces.
BLANKS = " \t\n\x0b\f\r\u3000\u00a0\ufeff"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row even where lambdas mention it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def any_of(words: Iterable[str], haystack: Column) -> Column:
    """Whether the text holds one of the words."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(haystack, w))


def first_of(words: Iterable[str], haystack: Column) -> Column:
    """The first word of the list that the text holds, else null."""
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(haystack, w)), F.lit(0))


def _numeric_references(text: Column, pattern: str, base: int) -> Column:
    """Each distinct numeric character reference replaced by its character; invalid code points by nothing."""

    def replaced(t: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"[0-9a-fA-F]+", 0)
        code = F.when(F.length(digits) <= 7, F.conv(digits, base, 10).cast("long"))
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.replace(t, ref, F.coalesce(char, F.lit("")))

    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), F.aggregate(found(t), t, replaced)).otherwise(t))


def decode_entities(text: Column, names: list[tuple[str, str]] = fixed.NEWS_ENTITIES, numeric_first: bool = False) -> Column:
    """Character references decoded; by default names first, so doubly encoded text decodes twice."""
    numeric = lambda t: _numeric_references(_numeric_references(t, "&#[0-9]+;", 10), "&#x[0-9a-fA-F]+;", 16)
    out = numeric(text) if numeric_first else text
    for name, char in names:
        out = F.replace(out, F.lit(name), F.lit(char))
    return out if numeric_first else numeric(out)


def decode_entities_intel(text: Column) -> Column:
    return decode_entities(text, fixed.INTEL_ENTITIES, numeric_first=True)


def latin_words(text: Column) -> Column:
    """ASCII letters with single spaces between words; runs of them are joined, as to replace all others takes many times as long."""
    letters = F.array_join(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z ]+"), F.lit(0)), "")
    return F.trim(F.regexp_replace(letters, " {2,}", " "))


def strip_markup(text: Column) -> Column:
    for pattern, by in fixed.MARKUP:
        text = F.regexp_replace(text, pattern, by)
    return text


def normalize_whitespace(text: Column) -> Column:
    text = F.translate(text, "　 ", "  ")
    for pattern, by in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return text


def trimmed(text: Column) -> Column:
    """Without white space at both ends, ideographic and no-break spaces included."""
    return F.trim(text, F.lit(BLANKS))


def per_line(text: Column, keep: Callable[[Column], Column]) -> Column:
    """The lines for which keep holds."""
    return F.array_join(F.filter(F.split(text, "\n", -1), keep), "\n")


def is_noise_line(line: Column) -> Column:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in fixed.NOISE_LINES)

    def judged(t: Column) -> Column:
        photo = (F.length(t) <= 25) & (t.rlike(fixed.PHOTO_WORDS) | (t.rlike(fixed.CREDIT_WORDS) & (F.length(t) <= 15)))
        # Every pattern holds an ideograph, "IC photo" or a line's first symbol: most lines of other scripts are done there.
        return (F.length(t) > 0) & t.rlike(r"(?i)[\x{4e00}-\x{9fff}]|ic\s*photo|^[-=*_#·•●○◎◇◆□■△▲※]") & (photo | t.rlike(pattern))

    return let(trimmed(line), judged)


def remove_noise_lines(text: Column) -> Column:
    return per_line(text, lambda x: ~is_noise_line(x))


def remove_trailers(text: Column) -> Column:
    """Cut at the first marker of recommended reading, adverts or rights."""
    return let(text, lambda t: F.when(any_of(fixed.TRAILERS, t), F.regexp_replace(t, "(?is)(?:" + "|".join(fixed.TRAILERS) + ")[：:].*$", "")).otherwise(t))


def strip_related_blocks(text: Column) -> Column:
    """Cut where a block of links to other items begins: a weak header, or once body text was seen a run of headlines."""
    is_body = lambda x: (F.length(x) > 60) & x.rlike("[。！？]")
    headline = lambda x: F.length(x).between(6, 42) & ~x.rlike("[。；：:，！？!?]")
    summary = lambda x: F.length(x).between(12, 90) & x.rlike("[。！？.!?]")

    def judged(x: Column) -> Column:
        return F.struct((F.length(x) > 0).alias("some"), headline(x).alias("headline"), summary(x).alias("summary"), is_body(x).alias("body"), x.rlike(fixed.WEAK_HEADERS).alias("header"))

    def paired(marks: Column) -> Column:
        return F.transform(marks, lambda m, i: F.struct(m["some"].alias("some"), m["headline"].alias("headline"), (m["headline"] & F.coalesce(F.get(marks, i + 1)["summary"], F.lit(False))).alias("pair"), m["body"].alias("body"), m["header"].alias("header")))

    def cut(marks: Column) -> Column:
        def begins(m: Column, i: Column, body: Column) -> Column:
            count = lambda near, name: F.size(F.filter(near, lambda x: x[name]))
            run = let(F.slice(marks, i + 1, F.lit(14)), lambda near: (count(near, "pair") >= 3) | (count(near, "headline") >= 4))
            return m["some"] & (m["header"] | ((body > 0) & (i >= body) & run))

        # Places count from 1, indexes from 0: a body's place is the first index behind it.
        found = let(F.array_position(F.transform(marks, lambda m: m["body"]), F.lit(True)).cast("int"), lambda body: F.array_position(F.transform(marks, lambda m, i: begins(m, i, body)), F.lit(True)).cast("int") - 1)
        return F.when((F.size(marks) >= 4) & (found >= 0), found)

    kept = lambda t, at: F.regexp_replace(F.array_join(F.slice(F.split(t, "\n", -1), F.lit(1), at), "\n"), r"[\s　]+$", "")
    place = lambda t: let(let(F.transform(F.split(t, "\n", -1), lambda x: let(trimmed(x), judged)), paired), cut)
    return let(text, lambda t: let(place(t), lambda at: F.when(at.isNull(), t).otherwise(kept(t, at))))


def remove_bracketed_meta(text: Column) -> Column:
    r = fixed.EDITOR_ROLES

    def removed(t: Column) -> Column:
        for pattern in (rf"(?i)[（(]\s*{r}[：:]\s*\S{{0,20}}\s*[）)]", rf"(?im)[（(]\s*{r}[：:]\s*\S{{0,20}}$", rf"(?im)\s*{r}[：:]\s*\S{{0,20}}\s*$"):
            t = F.regexp_replace(t, pattern, "")
        return t

    return let(text, lambda t: F.when(any_of(r.strip("()").split("|"), t), removed(t)).otherwise(t))


def squeezed(text: Column) -> Column:
    """Lower case without white space."""
    return F.lower(F.regexp_replace(text, "[\\s　 ]+", ""))


def remove_redundant_lines(text: Column, title: Column, source: Column) -> Column:
    """Without dated meta lines, repeats of the title and lines that only name the source."""
    source = F.coalesce(source, F.lit(""))
    known = F.struct(
        squeezed(F.coalesce(title, F.lit(""))).alias("title"), source.alias("source"), squeezed(source).alias("plain"), squeezed(F.concat(F.lit("来源："), source)).alias("from"), squeezed(F.concat(F.lit("author："), source)).alias("author"),
    )

    def keep(line: Column, k: Column) -> Column:
        def judged(t: Column, n: Column) -> Column:
            dated = t.rlike(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}") & (t.rlike(fixed.META_WORDS) | (F.length(t) < 60))
            same = (F.length(k["title"]) >= 4) & ((n == k["title"]) | ((F.length(n) >= 4) & (F.contains(n, k["title"]) | F.contains(k["title"], n))))
            names = (n == k["plain"]) | (n == k["from"]) | (n == k["author"]) | ((F.length(t) <= 6) & F.contains(t, k["source"]))
            return (F.length(t) == 0) | ~(dated | same | ((F.length(k["plain"]) >= 2) & names))

        return let(trimmed(line), lambda t: let(squeezed(t), lambda n: judged(t, n)))

    return let(known, lambda k: per_line(text, lambda x: keep(x, k)))


def truncate_at_sentence(text: Column, limit: int) -> Column:
    """At most limit characters, cut after the last sentence end if that keeps more than half."""
    head = F.substring(text, 1, limit)
    last = lambda mark: F.length(head) - F.locate(mark[::-1], F.reverse(head)) - len(mark) + 1
    found = lambda mark: F.when(F.contains(head, F.lit(mark)), last(mark)).otherwise(-1)
    at = F.greatest(found("。"), found("\n\n"), found(". "))
    cut = F.when(at > limit * 0.5, F.substring(text, F.lit(1), at + 1)).otherwise(head)
    return F.when(F.length(text) > limit, trimmed(cut)).otherwise(text)


def clean_content(content: Column, title: Column | None = None, source: Column | None = None, limit: int = 3000) -> Column:
    """News text ready for scoring: references, markup, white space, noise, trailers, related items, meta lines, paragraphs, length."""
    none = F.lit("")
    text = normalize_whitespace(strip_markup(decode_entities(F.coalesce(content, none))))
    text = let(remove_trailers(remove_noise_lines(text)), strip_related_blocks)
    text = remove_redundant_lines(remove_bracketed_meta(text), none if title is None else title, none if source is None else source)
    paragraphs = F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: F.length(x) > 0)
    return let(F.array_join(paragraphs, "\n\n"), lambda t: truncate_at_sentence(t, limit))


def clean_title(text: Column, limit: int = 120) -> Column:
    return F.substring(trimmed(F.regexp_replace(strip_markup(decode_entities(F.coalesce(text, F.lit("")))), r"\s+", " ")), 1, limit)


def clean_summary(text: Column, limit: int = 200) -> Column:
    return clean_title(text, limit)


def meaningful_paragraphs(text: Column, shortest: int, most: int) -> Column:
    """The first paragraphs of at least that length."""
    return F.slice(F.filter(F.transform(F.split(text, "\n", -1), trimmed), lambda x: F.length(x) >= shortest), 1, most)


def fingerprint_title(title: Column) -> Column:
    """Title for the fingerprint: one space for white space, brackets at the ends gone."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "), r"^[【\[]+|[】\]]+$", ""))


def match_title(title: Column) -> Column:
    """Ideographs, ASCII letters and digits only, lower case; empty for none."""
    return F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^一-龥a-zA-Z0-9]", ""))


def topic_key(title: Column, unicode_letters: bool = False) -> Column:
    """First 24 hex digits of the hash of a title's first 20 significant characters; null if it has none."""
    keep = r"[^\p{L}\p{N}]" if unicode_letters else "[^a-z0-9]"
    text = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), keep, ""), 1, 20)
    return F.when(F.length(text) > 0, F.substring(F.sha2(text, 256), 1, 24))


def strip_controls(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffd}\x{feff}\x{200b}\x{200c}\x{200d}]", ""))


def collapse_space(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, "[\\s　 ]+", " "))


def clean_intel(text: Column) -> Column:
    return collapse_space(strip_controls(decode_entities_intel(F.coalesce(text, F.lit("")))))


def letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]++", "")


def meaningful_length(content: Column, title: Column) -> Column:
    """Letters and digits before the first navigation phrase; 0 if they only repeat the title."""
    phrases = "|".join(p.replace("|", r"\|") for p in fixed.NAVIGATION)
    body = F.get(F.split(F.lower(F.coalesce(content, F.lit(""))), phrases, 2), F.lit(0))
    head = letters_and_digits(F.lower(F.coalesce(title, F.lit(""))))
    return let(letters_and_digits(body), lambda b: F.when((F.length(b) > 0) & (b == head), 0).otherwise(F.length(b)))


def _starts(words: list[str]) -> str:
    """Pattern of a token that starts with one of the words, tried by first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "(?<![a-z0-9_A-Z])(?:" + "|".join(f"{k}(?:{'|'.join(sorted(v, key=len))})" for k, v in sorted(by.items())) + ")[a-z0-9_A-Z]*+"


def keyword_hits(words: list[str], body: Column) -> Column:
    """How many of the words the lower-case text holds: phrases and ideographs anywhere, single words as tokens or as the start of one."""
    single = [w.lower() for w in words if w.isascii() and w.isalnum()]
    other = [w.lower() for w in words if not (w.isascii() and " " not in w)]

    def held(whole: Column) -> Column:
        count = lambda some: F.size(F.filter(F.array(*[F.lit(w) for w in some]), lambda w: F.contains(whole, w))) if some else F.lit(0)
        wide = [w for w in other if not w.isascii()]
        # Texts of ASCII and Latin letters need no look for the words of other scripts.
        return count([w for w in other if w.isascii()]) + F.when(whole.rlike(r"[^\x{0}-\x{24f}]"), count(wide)).otherwise(0)

    # The body may be an expression: without let each word would compute it anew.
    inside = let(body, held) if other else F.lit(0)
    if not single:
        return inside

    def counted(tokens: Column) -> Column:
        derived = lambda t, k: t.startswith(k) & F.substring(t, F.length(k) + 1, F.lit(1)).rlike("^(?:[a-z0-9]|)$")
        return F.size(F.filter(F.array(*[F.lit(w) for w in single]), lambda k: F.exists(tokens, lambda t: derived(t, k))))

    # One pass finds the few tokens that can count; each is then held against the words.
    return inside + let(F.array_distinct(F.regexp_extract_all(body, F.lit(_starts(single)), F.lit(0))), counted)


def is_mostly_english(text: Column) -> Column:
    """No ideograph, and four ASCII letters in a row."""
    t = F.coalesce(text, F.lit(""))
    return ~t.rlike("[一-龥]") & t.rlike("[A-Za-z]{4}")


def split_bold(text: Column) -> Column:
    """array<struct<text, bold>> of text cut at **."""
    parts = F.transform(F.split(text, r"\*\*", -1), lambda x, i: F.struct(x.alias("text"), (i % 2 == 1).alias("bold")))
    return F.filter(parts, lambda x: F.length(x["text"]) > 0)


def split_opinion(text: Column) -> Column:
    """struct<body, opinion>: the text before and behind the first mark of an opinion, without the separators around it; empty for what is missing."""
    whole, none = F.coalesce(text, F.lit("")), F.lit("")
    body, opinion = whole, none
    for mark in reversed(fixed.OPINION_MARKS):
        at = F.locate(mark, whole)
        body = F.when(at > 0, F.regexp_replace(trimmed(F.substring(whole, F.lit(1), at - 1)), fixed.OPINION_TAIL, "")).otherwise(body)
        opinion = F.when(at > 0, F.regexp_replace(trimmed(F.substring(whole, at + len(mark), F.length(whole))), fixed.OPINION_LEAD, "")).otherwise(opinion)
    return F.struct(body.alias("body"), opinion.alias("opinion"))


def card_field(markdown: Column, label: str) -> Column:
    """Value of the first line that has `- **label**：value`; empty if there is none."""
    return F.trim(F.regexp_extract(F.coalesce(markdown, F.lit("")), rf"(?i)- \*\*{label}\*\*：([^\n]*)", 1))


def block_kind(line: Column) -> Column:
    """title for a short line without sentence marks, else text."""
    return F.when((F.length(line) <= 8) & ~line.rlike("[。！？；，.!?;,]"), "title").otherwise("text")


def last_index(text: Column, marks: Iterable[str]) -> Column:
    """Position, from 0, of the last of some one-character marks; -1 for none."""
    return F.greatest(*[F.when(F.contains(text, F.lit(m)), F.length(text) - F.locate(m, F.reverse(text))).otherwise(-1) for m in marks])


def brief_summary(definition: Column, what_happened: Column) -> Column:
    """A definition of one plain sentence, else the head of the first paragraph, cut at a mark near its end or at a word."""
    one = F.regexp_replace(trimmed(F.coalesce(definition, F.lit(""))), r"^作者[｜|].*?\s+", "")
    body = F.replace(F.regexp_replace(trimmed(F.coalesce(what_happened, F.lit(""))), r"(?i)^\s*(?:（?AI\s*预测）?)?[:：]?\s*", ""), F.lit("**"), F.lit(""))
    first = F.get(F.filter(F.transform(F.split(body, r"\n+", -1), trimmed), lambda x: F.length(x) > 0), F.lit(0))

    def shortened(head: Column, target: Column) -> Column:
        mark, gap = last_index(head, "。，；："), last_index(head, " 的、")
        at_mark = lambda mark: F.when(mark >= target - 10, F.substring(head, F.lit(1), mark + 1)).otherwise(let(gap, at_gap))
        at_gap = lambda gap: F.when(gap > target * 0.5, F.substring(head, F.lit(1), gap)).otherwise(head)
        return let(mark, at_mark)

    def head_of(f: Column) -> Column:
        cut = let(F.when(F.length(f) < 200, 40).otherwise(50), lambda target: let(F.substring(f, F.lit(1), target), lambda head: shortened(head, target)))
        return let(cut, lambda c: trimmed(F.when(F.length(f) > F.length(c), F.concat(c, F.lit("…"))).otherwise(c)))

    def said(o: Column) -> Column:
        plain = F.length(o).between(10, 60) & ~F.contains(o, F.lit("\n")) & ~o.rlike(r"(?i)^[a-z0-9_\-:]+$")
        return F.when(plain, o).otherwise(let(first, lambda f: F.when(f.isNull(), F.substring(o, 1, 50)).otherwise(head_of(f))))

    return let(one, said)


def rolling_hash(text: Column) -> Column:
    """Signed 32-bit hash, h = 31 h + code of each character."""
    codes = F.transform(F.split(text, "", -1), lambda c: F.ascii(c).cast("long"))
    wrap = lambda v: ((v + 2147483648).bitwiseAND(F.lit(4294967295))) - 2147483648
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x))


def event_id(normal_title: Column) -> Column:
    hashed = F.lower(F.conv(rolling_hash(normal_title).bitwiseAND(F.lit(4294967295)).cast("string"), 10, 36))
    return F.when(F.length(normal_title) > 0, F.concat(F.lit("evt_"), hashed)).otherwise("evt_none")


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; null if both are empty."""
    x, y = F.array_distinct(F.split(a, "", -1)), F.array_distinct(F.split(b, "", -1))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.length(a) > 0) | (F.length(b) > 0), both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)))


def last_json_object(text: Column, schema: str) -> Column:
    """The struct of the JSON object in an answer: a fenced block, else the last flat object that is valid, else the stretch from the first to the last brace.

    A fenced block that is broken gives null, as do answers without a valid object and null ones.
    """
    said = F.coalesce(text, F.lit(""))
    fenced = F.regexp_extract(said, r"(?is)```(?:json)?\s*\n?(.*?)\s*```", 1)
    flat = F.filter(F.regexp_extract_all(said, F.lit(r"(?s)(\{.*?\})")), lambda x: F.try_parse_json(x).isNotNull())
    widest = F.regexp_extract(said, r"(?s)(\{.*\})", 1)

    def parsed(json: Column) -> Column:
        return F.when(F.try_parse_json(F.nullif(json, F.lit(""))).isNotNull() & F.trim(json).startswith("{"), F.from_json(json, schema))

    return parsed(F.when(fenced != "", fenced).when(F.size(flat) > 0, F.try_element_at(flat, F.lit(-1))).otherwise(widest))


# Titles, markdown answers -------------------------------------------------------------------------------------------


def clean_item_title(title: Column) -> Column:
    """Without an aggregator's prefix; a title that is nothing else stays."""
    t = trimmed(F.coalesce(title, F.lit("")))
    return F.coalesce(F.nullif(trimmed(F.regexp_replace(t, f"(?i){fixed.TITLE_NOISE}", "")), F.lit("")), t)


def category_name_key(name: Column) -> Column:
    """Lower case, no white space."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[\\s　 ﻿]+", ""))


def clean_markdown(line: Column) -> Column:
    """Without marks of emphasis, code, headings, quotes and links, and without emoji."""
    steps = [(r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^>\s?", ""), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", "")]
    out = F.coalesce(line, F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return trimmed(out)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n+", -1), trimmed), lambda x: x != "")


def _runs(parts: Column, starts: Callable[[Column, Column], Column], join: Callable[[Column], Column]) -> Column:
    """join of every run of parts; starts(part, position) says where a run begins (the first part always does)."""

    def cut(p: Column, at: Column) -> Column:
        return F.transform(at, lambda s, k: join(F.slice(p, s, F.coalesce(F.get(at, k + 1), F.size(p) + 1) - s)))

    def of(p: Column) -> Column:
        marks = F.filter(F.transform(p, lambda x, i: F.when((i == 0) | starts(x, F.get(p, i - 1)), i + 1)), lambda i: i.isNotNull())
        return let(marks, lambda at: cut(p, at))

    return let(parts, of)


def markdown_sections(answer: Column) -> Column:
    """array<struct<type, text>> of an answer: heading, bullet or para; neighbours of one type, headings apart, are one section.

    Lines that only name sources go.  A null or empty answer has no sections.
    """
    source = lambda x: x.rlike(r"^参考来源[:：]") | x.rlike(r"(?i)^(?:参考|来源)[:：]?\s*(?:\d+[.、]\s*)?https?://")
    heading, bullet = r"^#{1,6}\s+", r"^[-*]\s+"

    def part(x: Column) -> Column:
        kind = F.when(x.rlike(r"^\*\*[^*]+\*\*$") | x.rlike(heading), "heading").when(x.rlike(bullet), "bullet").otherwise("para")
        body = F.when(kind == "heading", F.regexp_replace(x, heading, "")).when(kind == "bullet", F.regexp_replace(x, bullet, "")).otherwise(x)
        return F.struct(kind.alias("type"), clean_markdown(body).alias("text"))

    parts = F.filter(F.transform(F.filter(_lines(answer), lambda x: ~source(x)), part), lambda x: x["text"] != "")
    joined = lambda run: F.struct(F.get(run, F.lit(0))["type"].alias("type"), F.array_join(F.transform(run, lambda x: x["text"]), "\n").alias("text"))
    return _runs(parts, lambda x, before: (x["type"] == "heading") | (x["type"] != before["type"]), joined)


def answer_points(answer: Column, title_under: int | None = 60, body_limit: int | None = 300) -> Column:
    """struct<summary, items: array<struct<title, body>>> of a search answer.

    A short first line without a number is the summary.  A line "title：body" begins an item, any other line continues the item before it.
    A title has under title_under characters, a line gives body_limit at most; None is no limit.
    """
    numbered, pattern = r"^\d+[.、]", r"(?s)^(?:\d+[.、]\s*)?(.+?)[:：]\s*(.*)$"

    def of(lines: Column) -> Column:
        first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
        head = ~first.rlike(numbered) & (F.length(first) < 40)
        rest = F.when(head & (F.size(lines) > 0), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)

        def part(x: Column) -> Column:
            title = F.regexp_extract(x, pattern, 1)
            begins = x.rlike(pattern) & (F.length(title) > 0) & (F.lit(True) if title_under is None else F.length(title) < title_under)
            body = F.when(begins, F.regexp_extract(x, pattern, 2)).otherwise(x)
            return F.struct(begins.alias("begins"), F.when(begins, title).otherwise("").alias("title"), (body if body_limit is None else F.substring(body, 1, body_limit)).alias("body"))

        def item(run: Column) -> Column:
            body = F.array_join(F.filter(F.transform(run, lambda x: x["body"]), lambda x, i: (i > 0) | (x != "")), "\n")
            return F.struct(F.get(run, F.lit(0))["title"].alias("title"), body.alias("body"))

        return F.struct(F.when(head, first).otherwise("").alias("summary"), _runs(F.transform(rest, part), lambda x, _: x["begins"], item).alias("items"))

    return let(F.transform(_lines(answer), clean_markdown), of)
