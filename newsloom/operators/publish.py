"""Publishing: guarded replacement, snapshots, merges of pages and categories, queues and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, times
from . import gates


def ready_to_replace(queue: DataFrame, in_flight: list[str], done: str = "done") -> DataFrame:
    """One row, ready: whether nothing is in flight and something is done."""
    return queue.agg(F.count_if(F.col("status").isin(*in_flight)).alias("in_flight"), F.count_if(F.col("status") == done).alias("done")).withColumn("ready", (F.col("in_flight") == 0) & (F.col("done") > 0))


def replaced_if_ready(published: DataFrame, batch: DataFrame, ready: DataFrame) -> DataFrame:
    """The batch where ready holds (one row), else what is published; the guard is one broadcast row."""
    guard = F.broadcast(ready.select("ready"))
    return batch.crossJoin(guard).where("ready").drop("ready").unionByName(published.crossJoin(guard).where("not ready").drop("ready"))


def snapshot(df: DataFrame, group: str, order: list[Column], n: int = 20) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def renewed_expiry(retained: Column, expires: Column, now: Column, days: int) -> Column:
    """A new expiry for rows that are not retained; retained ones keep theirs."""
    return F.when(F.coalesce(retained, F.lit(False)), expires).otherwise(now + days * 86400)


def kept_only(published: DataFrame, keep: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows to delete): deleted is what no kept key names and nobody retained."""
    named = keep.select(F.col(key), F.lit(True).alias("__named")).distinct()
    both = published.join(named, key, "left").withColumn("__stays", F.coalesce("__named", F.coalesce("retained", F.lit(False))))
    return both.where("__stays").drop("__named", "__stays"), both.where("not __stays").drop("__named", "__stays")


def merged_categories(df: DataFrame, key: str, category: str, categories: list[str], order: list[Column]) -> DataFrame:
    """Rows of several categories, each key once, from the first category that has it, in order of categories, then of rows."""
    rank = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(category))
    first = df.where(rank > 0).withColumn("__rank", rank).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__rank", *order)))
    return first.where(F.col("__n") == 1).drop("__n").withColumnRenamed("__rank", "category_rank")


def borrowed(df: DataFrame, wanted: Column, category: str, prefix: str = "rec_") -> DataFrame:
    """df and copies of the wanted rows under another category with a prefixed id; the rows themselves stay."""
    return df.unionByName(df.where(wanted).withColumn("id", F.concat(F.lit(prefix), F.col("id").cast("string")).cast(dict(df.dtypes)["id"])).withColumn("category", F.lit(category)))


def next_category(candidates: DataFrame, seen: DataFrame, key: str, rank: Column) -> DataFrame:
    """The first category that still has keys nobody has seen, with how many."""
    fresh = candidates.join(seen.select(key), key, "left_anti")
    return fresh.groupBy("category", rank.alias("rank")).agg(F.countDistinct(key).alias("n_new")).orderBy("rank").limit(1)


def first_of_each_section(entries: DataFrame, group: str, sections: Column, order: list[Column]) -> DataFrame:
    """Per group the first entry of each fingerprint of its sections; entries without sections go."""
    d = entries.withColumn("__f", F.xxhash64(sections)).where(F.size(sections) > 0)
    return d.withColumn("__n", F.row_number().over(Window.partitionBy(group, "__f").orderBy(*order))).where(F.col("__n") == 1).drop("__n", "__f")


def oldest_batch(queue: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The batch that a worker pulls: first in, first out."""
    return queue.orderBy(*order).limit(n)


def changed_pages(fetched: DataFrame, known: DataFrame, key: str, body: Column) -> DataFrame:
    """Fetched rows whose body differs from the one known under the key, or is new; known: key, body_hash."""
    hashed = fetched.withColumn("body_hash", F.sha2(body, 256))
    return hashed.join(known.select(key, "body_hash"), [key, "body_hash"], "left_anti")


def yields_to(done: Column, backlog: Column, most: int = 36) -> Column:
    """Whether a stage yields to the one after it: results wait, or the backlog is full."""
    return (done > 0) | (backlog >= most)


def board_summary(tasks: DataFrame) -> DataFrame:
    """Tasks by status, and the urgent ones that are open."""
    return tasks.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("priority").isin("P0", "P1") & (F.col("status") != "done")).alias("n_urgent_open"))


def hit_rate(blocked: Column, checked: Column, most: float = 0.2) -> Column:
    """struct<rate, alert> of a safety check."""
    rate = F.when(checked > 0, blocked / checked).otherwise(0.0)
    return F.struct(rate.alias("rate"), (rate > most).alias("alert"))


# Gates and fallbacks.


def ai_capable(content: Column, shortest: int = 100) -> Column:
    return F.length(F.trim(F.coalesce(content, F.lit("")))) >= shortest


def recommend_relaxed(category: Column, content: Column, gated: Column, shortest: int = 200) -> Column:
    """For recommend a body that is long enough stands in for the score's gate."""
    return F.when((category == "recommend") & (F.length(F.coalesce(content, F.lit(""))) >= shortest), F.lit(None).cast("string")).otherwise(gated)


def content_problem(content: Column) -> Column:
    """Why a cleaned text is not valid, or null."""
    t = text.trimmed(F.coalesce(content, F.lit("")))
    noise = t.rlike(r"(?is)^.{0,50}(来源|转载|版权|声明|免责).{0,50}$") | t.rlike(r"(?is)^(推荐|相关|更多).{0,30}(阅读|新闻|文章)$")
    return F.when(F.length(t) < 30, "short").when((F.length(t) < 100) & ~F.contains(t, F.lit("。")), "no sentence").when(noise, "noise")


def since(published: Column, bound: Column, keep_undated: bool = False) -> Column:
    """From the bound on, the bound itself included; undated rows only if asked for."""
    return F.coalesce(published >= bound, F.lit(keep_undated))


def tags_allowed(tags: Column, allowed: list[str], default: str = "life") -> Column:
    """Distinct allowed tags in their order, or the default alone."""
    kept = F.array_distinct(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: x.isin(*allowed)))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def indicator_hits(body: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(F.coalesce(body, F.lit(""))), w)))


def labelled(tags: Column, labels: dict[str, str]) -> Column:
    """array<struct<tag, label>>; a tag without a label is its own."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.transform(tags, lambda x: F.struct(x.alias("tag"), F.coalesce(F.try_element_at(known, x), x).alias("label")))


def summary_of(ai: Column, desc: Column, content: Column, title: Column, source: Column, adopted: int = 60) -> Column:
    """struct<summary, source>: a model's summary that is long enough, else the first paragraph that says something, else the title.

    Without a text of over 10 characters the description stays, marked title if it says nothing.  Nulls are empty.
    """
    none = F.lit("")
    given, head, body = text.trimmed(F.coalesce(desc, none)), F.coalesce(title, none), F.coalesce(content, none)
    lines = F.filter(F.transform(F.split(body, "\n", -1), text.trimmed), lambda x: ~gates.invalid_description(x, head, source))
    made = lambda value, kind: F.struct(value.alias("summary"), F.lit(kind).alias("source"))
    of_text = F.when(F.size(lines) > 0, made(F.get(lines, F.lit(0)), "content")).otherwise(made(head, "title"))
    as_given = F.when(gates.invalid_description(given, head, source), made(given, "title")).otherwise(made(given, "desc"))
    return F.when(F.length(F.coalesce(ai, none)) >= adopted, made(ai, "ai")).when(F.length(body) > 10, of_text).otherwise(as_given)


def body_of(content: Column, content_source: Column, raw: Column, summary: Column, summary_source: Column, title: Column, official: Column) -> Column:
    """struct<content, content_source> that is published: a model's text, else its summary, else a short text; never the fetched one.

    content is raw where no model has written it.  A body that would be empty is the summary, else the title.  Nulls are empty.
    """
    none = F.lit("")
    body, kind, brief, head = (F.coalesce(c, none) for c in (content, content_source, summary, title))
    official = F.coalesce(official, F.lit(False))
    kept = F.when(official & (body != "") & (body == F.coalesce(raw, none)), none).otherwise(body)
    allowed = kind.isin("ai_interpretation", "official_rss")
    by_model = (summary_source == "ai") & (brief != "")
    kept = F.when(allowed, kept).when(by_model, brief).otherwise(none)
    label = F.when(allowed, kind).when(by_model, "ai_summary").otherwise(F.when(kind == "fetched", none).otherwise(kind))
    short = F.when(by_model | ((brief != "") & (brief != head)), brief).otherwise(head)
    empty = (text.trimmed(kept) == "") & (short != "")
    return F.struct(F.when(empty, short).otherwise(kept).alias("content"), F.when(empty, F.when(official, "official_rss").otherwise("ai_summary")).otherwise(label).alias("content_source"))


# Shapes and queues ----------------------------------------------------------------------------------------------------


def shown_content(content: Column, content_source: Column) -> Column:
    """struct<content, content_source, blocked>: texts of other than the allowed sources are held back."""
    allowed = F.coalesce(content_source.isin(*fixed.SHOWN_SOURCES), F.lit(False))
    shown = F.when(allowed, F.coalesce(content, F.lit(""))).otherwise("")
    return F.struct(shown.alias("content"), F.when(allowed, content_source).otherwise(fixed.HELD_BACK).alias("content_source"), (~allowed).alias("blocked"))


def filled(value: Column, *others: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (value, *others)], F.lit(""))


def item_id(given: Column, source_id: Column, source_type: Column, url_key: Column) -> Column:
    """The given id, else source and the first 16 characters of the URL's key."""
    return filled(given, F.concat_ws("_", filled(source_id, source_type), F.substring(F.coalesce(url_key, F.lit("")), 1, 16)))


def in_focus(tags: Column, focus: Column) -> Column:
    """Whether an item has a tag of the profile."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.arrays_overlap(F.coalesce(tags, none), F.coalesce(focus, none)), F.lit(False))


def story_blocks(happened: Column, prediction: Column) -> Column:
    """array<struct<type, text>>: paragraphs as text, then the prediction; one that stands first before others is text."""
    clean = lambda x: text.trimmed(F.coalesce(x, F.lit("")))
    paragraphs = F.filter(F.transform(F.split(clean(happened), r"\n{2,}", -1), text.trimmed), lambda x: x != "")
    block = lambda kind: lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    said = F.filter(F.array(clean(prediction)), lambda x: x != "")
    return demoted(F.concat(F.transform(paragraphs, block("text")), F.transform(said, block("predict"))))


def demoted(blocks: Column) -> Column:
    """Blocks where a prediction in the first place, with others behind it, counts as text."""
    first = lambda x, i: (i == 0) & (x["type"] == "predict") & (F.size(blocks) > 1)
    return F.transform(blocks, lambda x, i: F.struct(F.when(first(x, i), "text").otherwise(x["type"]).alias("type"), x["text"].alias("text")))


def detail(row: dict[str, Column]) -> Column:
    """A detail without nulls: names, times and the source of the content fall back on what there is."""
    empty = lambda name: F.coalesce(row.get(name, F.lit(None)).cast("string"), F.lit(""))
    of = F.when((empty("content_source") == "") & (empty("summary") != ""), "ai_interpretation").otherwise(empty("content_source"))
    plain = [empty(n).alias(n) for n in ("id", "title", "summary", "content", "category", "source", "source_url")]
    return F.struct(*plain, of.alias("content_source"), filled(empty("source_name"), empty("source")).alias("source_name"), filled(empty("publish_time"), empty("time")).alias("publish_time"))


def readable(value: Column) -> Column:
    """Without characters that stand for broken ones, and without control characters but tab and line breaks; empty for null."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def in_paragraphs(value: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(readable(value), "\n+", -1), text.trimmed), lambda x: x != "")


def intel_detail(row: dict[str, Column]) -> Column:
    """A detail as it is read: texts without broken characters, the definition, what happened and practice in paragraphs, blocks of known types, times of day in Beijing."""
    of = lambda name, kind="string": row.get(name, F.lit(None)).cast(kind)
    blocks = F.transform(
        row.get("blocks", F.array().cast("array<struct<type: string, text: string>>")), lambda b: F.struct(F.when(b["type"].isin("plain", "predict", "def"), b["type"]).otherwise("text").alias("type"), readable(b["text"]).alias("text"))
    )
    return F.struct(
        of("id").alias("id"), *[readable(of(n)).alias(n) for n in ("title", "url", "source_name", "source_url", "published", "happened", "scene", "action")], *[in_paragraphs(of(n)).alias(f"{n}_lines") for n in ("definition", "happened", "practice")],
        F.coalesce(F.filter(blocks, lambda b: b["text"] != ""), F.array()).alias("blocks"), F.coalesce(of("relevance"), F.lit("")).alias("relevance"), F.coalesce(of("tryable", "boolean"), F.lit(False)).alias("tryable"),
        filled(of("research"), F.lit("todo")).alias("research"), times.absolute_label(of("processed", "long")).alias("processed"),
    )


def appended_new(page: DataFrame, shown: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of a page whose key is not shown yet, each key once; rows without a key go."""
    fresh = page.where(F.col(key).isNotNull()).join(shown.select(key), key, "left_anti")
    return fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") == 1).drop("__n")


def claimed(queue: DataFrame, as_of: int, n: int, key: str = "id") -> DataFrame:
    """The batch that a worker takes: the oldest n that are pending or whose claim ran out; of these, no item that failed too often or a short time ago."""
    free = (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("claimed_at") < as_of - fixed.CLAIM_LEASE))
    cool = (F.coalesce("failed_at", F.lit(0)) == 0) | (as_of - F.col("failed_at") >= fixed.RETRY_COOLDOWN)
    return oldest_batch(queue.where(free), [F.col("created"), F.col(key)], n).where((F.coalesce("retries", F.lit(0)) < fixed.MOST_RETRIES) & cool)


def after_attempt(queue: DataFrame, outcomes: DataFrame, as_of: int, key: str = "id") -> DataFrame:
    """The queue after a batch; outcomes: key and one of done, failed, postponed.  Three failures or twenty postponements discard."""
    q = queue.join(outcomes.select(key, F.col("outcome").alias("__o")), key, "left")
    o = F.coalesce("__o", F.lit(""))
    retries = F.coalesce("retries", F.lit(0)) + (o == "failed").cast("int")
    skips = F.coalesce("skips", F.lit(0)) + (o == "postponed").cast("int")
    over = ((o == "failed") & (retries >= fixed.MOST_RETRIES)) | ((o == "postponed") & (skips >= fixed.MOST_SKIPS))
    status = F.when(o == "done", "done").when(over, "discarded").when(o.isin("failed", "postponed"), "pending").otherwise(F.col("status"))
    changed = {"status": status, "retries": retries, "skips": skips, "failed_at": F.when(o == "failed", F.lit(as_of)).otherwise(F.col("failed_at"))}
    return q.select(*[changed[c].cast(kind).alias(c) if c in changed else F.col(c) for c, kind in queue.dtypes])


def pending_verdict(fetched: Column, failures: Column, as_of: Column) -> Column:
    """Why a pending item is rejected, or null: it waited over two days, or failed three times."""
    return F.when(as_of - fetched > fixed.STALE_PENDING, "stale-pending(>48h)").when(F.coalesce(failures, F.lit(0)) >= fixed.MOST_RETRIES, "llm-fail-retry-exhausted")


# Shapes of lists and channels ---------------------------------------------------------------------------------------------


def list_shape(row: dict[str, Column], since: bool = False) -> Column:
    """An entry of a list without nulls where text is shown: cleaned title, category's name, source and marks; scores may be null.

    since gives the entry of a delta: without content, opinion and scores, with the time of creation.
    """
    of = lambda name, kind="string": row.get(name, F.lit(None)).cast(kind)
    empty = lambda *names: [F.coalesce(of(n), F.lit("")).alias(n) for n in names]
    known = F.lit("")
    for name, label in fixed.CATEGORY_LABELS.items():
        known = F.when(of("category") == name, label).otherwise(known)
    shared = [
        of("id").alias("id"), text.clean_title(of("title")).alias("title"), of("summary").alias("summary"), *empty("summary_source"), of("category").alias("category"), filled(of("category_name"), known).alias("category_name"),
        of("source").alias("source"), *empty("source_url", "content_source", "source_name"), of("publish_time").alias("publish_time"), F.coalesce(of("retained", "boolean"), F.lit(False)).alias("retained"),
    ]
    if since:
        return F.struct(*shared, of("created", "long").alias("created"))
    return F.struct(*shared, *empty("content", "opinion", "event_id"), *[of(n, "double").alias(n) for n in ("final", "quality", "heat")])


def channel_item(item: Column, labels: dict[str, str] = fixed.CARD) -> Column:
    """A brief's item (id, title, url, source_name, source_id, published, card, contract, tryable, scenes, relevance, rank) as a channel shows it: lines of the card by name, scenes with labels."""
    none = F.lit("")
    lines = [text.card_field(item["card"], labels[n]).alias(n) for n in ("definition", "scene", "practice", "action")]
    scenes = labelled(F.coalesce(item["scenes"], F.array().cast("array<string>")), fixed.SCENE_LABELS)
    return F.struct(
        F.coalesce(item["id"], none).alias("id"), item["title"].alias("title"), F.coalesce(item["url"], none).alias("url"), filled(item["source_name"], item["source_id"]).alias("source_name"), F.coalesce(item["published"], none).alias("published"),
        *lines, F.coalesce(item["card"], none).alias("card"), F.coalesce(item["tryable"], F.lit(False)).alias("tryable"), F.coalesce(item["contract"], F.lit(False)).alias("contract"), scenes.alias("scenes"),
        filled(item["relevance"], F.lit("medium")).alias("relevance"), F.coalesce(item["rank"], F.lit(0)).alias("rank"),
    )


def channel_payload(brief: dict[str, Column]) -> Column:
    """What a channel shows of a brief (date, version, mode, locked, fetched, generated, banner, items): items with a title only, times in Beijing.

    The time of the data is that of the fetch, else of the making; a brief without items has no content.
    """
    of = lambda name, kind: brief.get(name, F.lit(None)).cast(kind)
    items = F.filter(brief["items"], lambda x: F.coalesce(x["title"], F.lit("")) != "")
    at = F.coalesce(F.nullif(of("fetched", "long"), F.lit(0).cast("long")), of("generated", "long"))
    clock = F.coalesce(times.clock(at), F.lit(""))
    return F.struct(
        F.coalesce(of("date", "string"), F.lit("")).alias("date"), F.coalesce(of("version", "int"), F.lit(0)).alias("version"), filled(of("mode", "string"), F.lit("increment")).alias("mode"), F.coalesce(of("locked", "boolean"), F.lit(False)).alias("locked"),
        clock.alias("clock"), F.when(clock == "", "").otherwise(F.concat(F.lit("数据截至 "), clock)).alias("label"), F.coalesce(F.transform(items, lambda x: channel_item(x)), F.array()).alias("items"), (F.coalesce(F.size(items), F.lit(0)) > 0).alias("has_content"),
        F.coalesce(of("banner", "string"), F.lit("")).alias("banner"),
    )


def grouped_lists(df: DataFrame, group: str, item: str, order: list[Column], cap: int) -> DataFrame:
    """group and items: the first ``cap`` items of each group in order, as an array of a bounded size."""
    top = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__n") <= cap)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", item))), lambda x: x[item]).alias("items"))
