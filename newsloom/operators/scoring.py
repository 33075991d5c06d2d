"""Quality, heat and final scores of news items, event clusters and routing, as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text, times, urls
from . import gates


def source_authority(source: Column, url: Column) -> Column:
    """Aggregators first, then names, then hosts of the central and the regional press, else unknown."""
    s, h = F.trim(F.coalesce(source, F.lit(""))), urls.host(url)
    out = F.when(s == "", fixed.UNKNOWN_AUTHORITY).when(text.any_of(fixed.AGGREGATORS, s), fixed.AGGREGATOR_AUTHORITY)
    for score, names in fixed.AUTHORITY.items():
        out = out.when(s.isin(*names), score)
    return out.when(h.rlike(fixed.CENTRAL_HOSTS), 100).when(h.rlike(fixed.REGIONAL_HOSTS), 80).otherwise(fixed.UNKNOWN_AUTHORITY)


def completeness(content: Column, summary: Column) -> Column:
    """By length of the content, else of the summary; two sentence ends add a tenth of what is missing."""
    c, s = (F.trim(F.coalesce(x, F.lit(""))) for x in (content, summary))
    body = F.when(F.length(c) > 0, c).otherwise(s)
    base = F.when(F.length(body) >= 300, 90).when(F.length(body) >= 80, 60).when(F.length(body) > 0, 20).otherwise(0)
    two_ends = body.rlike("(?s)[。！？.!?].*?[。！？.!?]")
    return F.when((base > 0) & two_ends, F.round(base + 0.1 * (100 - base)).cast("int")).otherwise(base)


def timeliness(published: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0.0), (as_of - published) / 3600.0)
    return F.when(published.isNull(), 50).otherwise(F.round(100 * F.exp(-age / 48)).cast("int"))


def noise_ratio(content: Column, raw: Column) -> Column:
    c, r = F.length(F.trim(F.coalesce(content, F.lit("")))), F.length(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(r > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - c / F.nullif(r, F.lit(0))))).otherwise(0.05)


def text_quality(content: Column, raw: Column) -> Column:
    empty = F.length(F.trim(F.coalesce(content, F.lit("")))) == 0
    return F.when(empty, 0).otherwise(F.round(100 * (1 - noise_ratio(content, raw))).cast("int"))


def batch_duplicates(df: DataFrame, order: list[Column], title: str = "title", url: str = "url", keep_reference: bool = False) -> DataFrame:
    """df with dup: whether title or URL stood in the batch before; empty keys never repeat.

    keep_reference marks every row a duplicate, the constant that the older rule amounts to.
    """
    if keep_reference:
        return df.withColumn("dup", F.lit(True))
    # Rows without a key are spread, else all of them meet in one task.
    spread = lambda key: F.coalesce(key, F.concat(F.lit("\x00"), F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]).cast("string")))
    seen = lambda key: F.coalesce((F.row_number().over(Window.partitionBy(spread(key)).orderBy(*order)) > 1) & key.isNotNull(), F.lit(False))
    t, u = F.nullif(text.match_title(F.col(title)), F.lit("")), urls.url_key(F.col(url))
    return df.withColumn("__t", t).withColumn("__u", u).withColumn("dup", seen(F.col("__t")) | seen(F.col("__u"))).drop("__t", "__u")


def quality_score(source: Column, complete: Column, fresh: Column, quality: Column, uniq: Column, soft: Column) -> Column:
    w = fixed.QUALITY_WEIGHTS
    total = F.round(w["source"] * source + w["complete"] * complete + w["fresh"] * fresh + w["text"] * quality + w["uniq"] * uniq).cast("int")
    return F.when(soft.isNotNull(), F.greatest(F.lit(0), total - fixed.SOFT_PENALTY)).otherwise(total)


def event_heat(sources: Column, members: Column) -> Column:
    return 10 * sources + F.least(F.lit(10), members)


def topic_heat(category: Column, sources: Column) -> Column:
    base = F.lit(fixed.TOPIC_HEAT_OTHER)
    for name, heat in fixed.TOPIC_HEAT.items():
        base = F.when(category == name, heat).otherwise(base)
    return base + F.when(sources >= 2, 10).otherwise(0)


def heat_score(event: Column, topic: Column, engaged: Column, published: Column, as_of: Column) -> Column:
    age = F.greatest(F.lit(0.0), (as_of - F.coalesce(published, as_of)) / 3600.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.coalesce(event, F.lit(10)) + topic + F.coalesce(engaged, F.lit(0))) * F.exp(-age / 24)))).cast("int")


def final_score(quality: Column, heat: Column) -> Column:
    a, b = fixed.FINAL_WEIGHTS
    return F.round(a * quality + b * heat).cast("int")


def score_items(items: DataFrame, as_of: Column) -> DataFrame:
    """items (id, title, summary, content, raw, source, url, category, published) with scores and gate.

    One window for each of the two duplicate keys and one aggregate for events
    with equal titles; everything else stays in the row.
    """
    hard, soft = gates.compliance(F.col("title"), F.col("summary"), F.col("content"), urls.url_date(F.col("url")), as_of)
    df = batch_duplicates(items, [F.col("published"), F.col("id")])
    df = df.withColumn("hard", hard).withColumn("soft", soft).withColumn("event_key", text.match_title(F.col("title")))
    known = F.col("event_key") != ""
    event = Window.partitionBy(F.when(known, F.col("event_key")).otherwise(F.concat(F.lit("\x00"), F.xxhash64("id").cast("string"))))
    df = df.withColumn("n_sources", F.when(known, F.size(F.collect_set("source").over(event)))).withColumn("n_members", F.when(known, F.count("*").over(event)))
    df = df.withColumn("noise", noise_ratio(F.col("content"), F.col("raw")))
    quality = quality_score(
        source_authority(F.col("source"), F.col("url")), completeness(F.col("content"), F.col("summary")), timeliness(F.col("published"), as_of),
        text_quality(F.col("content"), F.col("raw")), F.when(F.col("dup"), 0).otherwise(100), F.col("soft"),
    )
    df = df.withColumn("quality", F.when(F.col("hard").isNotNull(), 0).otherwise(quality))
    df = df.withColumn("heat", heat_score(event_heat(F.col("n_sources"), F.col("n_members")), topic_heat(F.col("category"), F.coalesce("n_sources", F.lit(1))), F.lit(0), F.col("published"), as_of))
    df = df.withColumn("final", final_score(F.col("quality"), F.col("heat")))
    return df.withColumn("gated", gate(F.col("hard"), F.col("quality"), F.col("noise")))


def gate(hard: Column, quality: Column, noise: Column) -> Column:
    return F.when(hard.isNotNull(), "compliance").when(quality < fixed.MIN_QUALITY, "quality").when(noise > fixed.MAX_NOISE, "noise")


def feed_heat(authority: Column) -> Column:
    """Heat of an official feed's item: fixed by the authority of its source, without any decay."""
    out = F.lit(fixed.FEED_HEAT_OTHER)
    for least, heat in reversed(fixed.FEED_HEAT):
        out = F.when(authority >= least, heat).otherwise(out)
    return out


def feed_score(source: Column, url: Column, summary: Column, published: Column, hard: Column, as_of: Column) -> Column:
    """struct<quality, heat, final, gated> of an official feed's item, scored by itself: the summary stands for the content, and it counts as unique."""
    authority = source_authority(source, url)
    said = text.trimmed(F.coalesce(summary, F.lit("")))
    tidy = F.when(said == "", 0).otherwise(fixed.FEED_TEXT)
    quality = F.when(hard.isNotNull(), 0).otherwise(quality_score(authority, completeness(summary, summary), timeliness(published, as_of), tidy, F.lit(100), F.lit(None).cast("string")))
    heat = feed_heat(source_authority(source, F.lit("")))
    noise = F.when(said == "", 0.0).otherwise(fixed.FEED_NOISE)
    return F.struct(quality.alias("quality"), heat.alias("heat"), final_score(quality, heat).alias("final"), gate(hard, quality, noise).alias("gated"))


def relevance(body: Column, focus: list[str], depth: str = "std") -> Column:
    """struct<score, level> of an item: AI words count 1 up to 3, focus words 2 up to 6."""
    high = {"deep": 3, "lite": 5}.get(depth, 4)

    def scored(b: Column) -> Column:
        base = F.least(text.keyword_hits(fixed.AI_WORDS, b), F.lit(3))
        return base + F.least(sum((F.when(F.contains(b, F.lit(w.lower())), 2).otherwise(0) for w in focus), F.lit(0)), F.lit(6))

    level = lambda s: F.when(s >= high, "high").when(s >= 1, "medium").otherwise("low")
    return text.let(text.let(body, scored), lambda s: F.struct(s.alias("score"), level(s).alias("level")))


def lens_route(title: Column, summary: Column, category: Column, quality: Column, final: Column, key: Column) -> Column:
    """struct<lens, allow_opinion, variant>: barred subjects first, then open questions, life, hard news of high score, middling score, else brief.

    The score is the quality, else the final score, else 50; variant is the same for the same key.
    """
    none = F.lit("")
    said = F.concat_ws(" ", F.coalesce(title, none), F.coalesce(summary, none))
    s = F.coalesce(quality, final, F.lit(50))
    lens = (
        F.when(text.any_of(fixed.NO_OPINION, said), "brief")
        .when(text.any_of(fixed.UNSETTLED, F.coalesce(title, none)) & (s >= fixed.LENS_OPINION), "ask")
        .when(category.isin(*fixed.LIFE_CATEGORIES) & (s >= fixed.LENS_OPINION), "life")
        .when((s >= fixed.LENS_COLD) & category.isin(*fixed.HARD_CATEGORIES), "cold")
        .when(s >= fixed.LENS_DEPTH, "depth")
        .otherwise("brief")
    )
    return F.struct(lens.alias("lens"), (lens != "brief").alias("allow_opinion"), F.abs(text.rolling_hash(F.coalesce(key, none))).alias("variant"))


def length_budget(lens: Column, shortest: Column, longest: Column) -> Column:
    """struct<t_min, t_max>: the lengths wanted, scaled by the lens, 120 and 60 more at least."""
    factor = F.lit(1.0)
    for name, x in fixed.LENS_FACTORS.items():
        factor = F.when(lens == name, x).otherwise(factor)
    low = F.greatest(F.lit(120), F.floor(F.coalesce(shortest, F.lit(300)) * factor + 0.5).cast("int"))
    return F.struct(low.alias("t_min"), F.greatest(low + 60, F.floor(F.coalesce(longest, F.lit(600)) * factor + 0.5).cast("int")).alias("t_max"))


def search_fast_path(query: Column) -> Column:
    """true where a word of the subject stands in the query and none of other subjects; null otherwise: a model decides."""
    q = F.lower(F.coalesce(query, F.lit("")))
    related = text.any_of([w.lower() for w in fixed.SEARCH_WORDS], q)
    return F.when(text.any_of(fixed.SEARCH_OTHER, q), F.lit(None)).when(related, F.lit(True)).cast("boolean")


def accepted_output(summary: Column, interpretation: Column, shortest: Column) -> Column:
    """struct<summary_usable, summary_adopted, interpretation>: whether a model's answers are long enough; shortest is the length asked for."""
    least = F.greatest(F.lit(50), F.floor(shortest * 0.25 + 0.5).cast("int"))
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.struct((n(summary) >= 30).alias("summary_usable"), (n(summary) >= 60).alias("summary_adopted"), (n(interpretation) >= least).alias("interpretation"))


def decayed(final: Column, published: Column, as_of: Column, per_hour: float = 1.0) -> Column:
    return final - per_hour * F.greatest(F.lit(0.0), (as_of - published) / 3600.0)
