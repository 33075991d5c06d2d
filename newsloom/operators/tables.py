"""Table operators: dedup, anti joins, merges, top N, paging, versions, threads and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import gates

# Dedup ------------------------------------------------------------------------------------------------------------


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows without any key stay."""
    missing = reduce(lambda a, b: a & b, [F.col(k).isNull() for k in keys])
    # Rows without a key are spread, else all of them meet in one task.
    spread = F.when(missing, F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind]))
    n = F.row_number().over(Window.partitionBy(*keys, spread).orderBy(*order))
    return df.withColumn("__n", n).where((F.col("__n") == 1) | missing).drop("__n")


def best_per_key(df: DataFrame, key: str, rank: Column) -> DataFrame:
    """The row of highest rank of each key: one aggregate, combined before the shuffle.  Rows travel whole, so wide ones are best ranked by their keys first."""
    picked = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), rank).alias("__row"))
    return picked.select("__row.*")


def two_key_anti_join(new: DataFrame, old: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of new that share neither key with old."""
    return new.join(old.select(first).where(F.col(first).isNotNull()).distinct(), first, "left_anti").join(old.select(second).where(F.col(second).isNotNull()).distinct(), second, "left_anti")


def dedup_key(url: Column, title: Column) -> Column:
    """The URL, else T: and the title."""
    return F.coalesce(F.nullif(F.trim(url), F.lit("")), F.concat(F.lit("T:"), F.coalesce(title, F.lit(""))))


def topic_action(candidate_length: Column, known_length: Column, known_status: Column, gain: int = 200) -> Column:
    """insert an unknown topic, upgrade a pending one by a clearly longer text, drop the rest."""
    return F.when(known_status.isNull(), "insert").when((known_status == "pending") & (candidate_length > known_length + gain), "upgrade").otherwise("drop")


# Merges -----------------------------------------------------------------------------------------------------------


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: list[str] = ()) -> DataFrame:
    """Incoming rows over existing ones; columns of keep stay as they were where a row existed."""
    old = existing.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in existing.columns if c != key], F.lit(True).alias("__old"))
    new = incoming.withColumn("__new", F.lit(True))
    both = new.join(old, key, "full_outer")
    pick = lambda c: F.when(F.col("__new") & ~(F.coalesce("__old", F.lit(False)) if c in keep else F.lit(False)), F.col(c)).otherwise(F.col(f"__{c}"))
    return both.select(key, *[pick(c).alias(c) for c in existing.columns if c != key])


def best_of_batch(batch: DataFrame, key: str = "dedup_key", order: Column | None = None) -> DataFrame:
    """One row of each key of a batch: an interpretation before a model's summary before others, then one with an opinion, then quality; ties to the first in order."""
    kind = F.when(F.col("content_source") == "ai_interpretation", 3.0).when(F.col("content_source") == "ai_summary", 2.0).otherwise(0.0)
    opinion = F.when(F.trim(F.coalesce("opinion", F.lit(""))) != "", 0.5).otherwise(0.0)
    rank = kind + opinion + F.coalesce(F.col("quality"), F.lit(0)) / 100
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank.desc(), F.col(key) if order is None else order))
    return batch.withColumn("__n", place).where(F.col("__n") == 1).drop("__n")


def merge_published(existing: DataFrame, incoming: DataFrame, as_of: int, key: str = "dedup_key") -> DataFrame:
    """Published rows after a batch, a row a key on both sides.

    Both have title, source, summary, summary_source (ai, desc or title), content, content_source, opinion, created, retained,
    retained_at and expires; other columns are taken as they come.  A model's summary is not replaced by another kind, a
    description that says something not by a shorter one.  Fetched text that a model's summary stands for is marked so, and
    without a text it has no mark.  An interpretation gives way only to another one or to an official feed.  The time of creation
    and retention stay; a retained row lives 30 days from when it was retained, others 7 days from now.
    """
    e = existing.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in existing.columns if c != key], F.lit(True).alias("__there"))
    j = incoming.withColumn("__new", F.lit(True)).join(e, key, "full_outer")
    none = F.lit("")
    said, old_said = F.coalesce("summary", none), F.coalesce("__summary", none)
    kind = F.coalesce(F.nullif("summary_source", none), F.when((said == "") | (said == F.coalesce("title", none)), "title").otherwise("desc"))
    old_kind = F.coalesce(F.nullif("__summary_source", none), F.when((old_said != "") & (old_said != F.coalesce("__title", none)), "desc").otherwise("title"))
    there = F.coalesce("__there", F.lit(False))
    old_ai = there & (old_kind == "ai") & (kind != "ai")
    worthy = ~gates.invalid_description(old_said, F.col("title"), F.col("source"))
    old_desc = there & (old_kind != "ai") & (kind != "ai") & worthy & (F.length(old_said) > F.length(said))
    summary = F.when(old_ai | old_desc, old_said).otherwise(said)
    summary_source = F.when(old_ai, "ai").when(old_desc, "desc").otherwise(kind)
    body, mark = F.coalesce("content", none), F.coalesce("content_source", none)
    mark = F.when((mark == "fetched") & (summary_source == "ai") & (summary != ""), "ai_summary").when((mark == "fetched") & (text.trimmed(body) == ""), none).otherwise(mark)
    guarded = there & (F.col("__content_source") == "ai_interpretation") & ~mark.isin("ai_interpretation", "official_rss")
    keep = lambda c: F.when(F.coalesce(guarded, F.lit(False)), F.coalesce(F.nullif(f"__{c}", none), F.coalesce(c, none))).otherwise(F.coalesce(c, none))
    retained = there & F.coalesce("__retained", F.lit(False))
    retained_at = F.when(retained, F.coalesce("__retained_at", F.lit(as_of).cast("long")))
    picked = {
        "summary": summary, "summary_source": summary_source, "content": keep("content"), "opinion": keep("opinion"), "content_source": F.when(F.coalesce(guarded, F.lit(False)), "ai_interpretation").otherwise(mark),
        "created": F.coalesce("__created", F.lit(as_of).cast("long")), "retained": retained, "retained_at": retained_at, "expires": F.when(retained, retained_at + fixed.RETAINED_TTL).otherwise(F.lit(as_of + fixed.PUBLISHED_TTL)),
    }
    old = lambda c: F.col(f"__{c}") if c in existing.columns else F.lit(None)
    return j.select(key, *[F.when(F.col("__new"), picked.get(c, F.col(c))).otherwise(old(c)).cast(kind_).alias(c) for c, kind_ in incoming.dtypes if c != key])


def override_by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """Union of lists where a later one overrides an earlier one by key."""
    tagged = [f.withColumn("__p", F.lit(i)) for i, f in enumerate(frames)]
    return best_per_key(reduce(DataFrame.unionByName, tagged), key, F.col("__p")).drop("__p")


def fallback_tiers(frames: list[DataFrame]) -> DataFrame:
    """Rows of the first list that has any."""
    tagged = reduce(DataFrame.unionByName, [f.withColumn("tier", F.lit(i)) for i, f in enumerate(frames)])
    return tagged.join(F.broadcast(tagged.agg(F.min("tier").alias("tier"))), "tier", "left_semi")


def fresh_or_all(df: DataFrame, fresh: Column) -> DataFrame:
    """Fresh rows; all of them only if none is."""
    some = df.agg(F.max(F.when(fresh, 1).otherwise(0)).alias("__some"))
    return df.crossJoin(F.broadcast(some)).where(fresh | (F.col("__some") == 0)).drop("__some")  # one row


def lookup_chain(keys: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """For each key its row of the first table that has one."""
    found = reduce(DataFrame.unionByName, [t.join(keys.select(key).distinct(), key, "left_semi").withColumn("found_in", F.lit(i)) for i, t in enumerate(tables)])
    return best_per_key(found, key, -F.col("found_in"))


# Ranking and paging -------------------------------------------------------------------------------------------------


def top_per_group(df: DataFrame, group: str, order: list[Column], cap: Column | int, rank: str = "rank") -> DataFrame:
    """The first rows of each group with their rank; the limit is pushed below the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= cap)


def category_cap(category: Column, caps: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, n in caps.items():
        out = F.when(category == name, n).otherwise(out)
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a ranked list; sizes are held within 1 and 50, and only the rows up to its end are sorted."""
    size = max(1, min(50, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    size = max(1, min(50, size))
    return df.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > number * size)


def delta(df: DataFrame, written: str, since: Column, most: int = 20, tie: str = "id") -> DataFrame:
    """Rows written since an instant, oldest first."""
    return df.where(F.col(written) >= since).orderBy(written, tie).limit(most)


def latest_version(df: DataFrame, day: str, version: str) -> DataFrame:
    return best_per_key(df, day, F.col(version))


def next_version(current: DataFrame, issue: DataFrame, day: str = "day") -> DataFrame:
    """An issue with the version after the day's latest."""
    last = current.groupBy(day).agg(F.max("version").alias("__last"))
    return issue.join(last, day, "left").withColumn("version", F.coalesce(F.col("__last") + 1, F.lit(1))).drop("__last")


def source_capped(ranked: DataFrame, source: str, order: list[Column], cap: int) -> DataFrame:
    """At most cap items of each source, in the order of the list."""
    return top_per_group(ranked, source, order, cap, "__in_source").drop("__in_source")


def recent_per_user(df: DataFrame, user: str, item: str, at: str, cap: int = 200, ttl: int | None = None, as_of: int | None = None) -> DataFrame:
    """Each user's latest items: the last event of an item counts, expired ones go, and only cap stay."""
    last = df.groupBy(user, item).agg(F.max(at).alias(at))
    if ttl is not None:
        last = last.where(F.col(at) > as_of - ttl)
    return top_per_group(last, user, [F.desc(at), F.col(item)], cap)


# Threads ------------------------------------------------------------------------------------------------------------


def thread_depth(nodes: DataFrame, node: str, parent: str, levels: int = 4) -> DataFrame:
    """root and depth of every node by joining a level at a time; deeper nodes count for the last level."""
    links = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__p"))
    out = nodes.select(node, F.coalesce(parent, node).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(levels - 1):
        up = links.where("__p is not null")
        out = out.join(up, F.col("root") == F.col("__n"), "left").select(node, F.coalesce("__p", "root").alias("root"), (F.col("depth") + F.when(F.col("__p").isNotNull(), 1).otherwise(0)).alias("depth"))
    return out


def mine(comments: DataFrame, user: str) -> DataFrame:
    """Roots a user wrote or replied to."""
    own = comments.where((F.col("user_id") == user) & F.col("root_id").isNull()).select("id")
    replied = comments.where((F.col("user_id") == user) & F.col("root_id").isNotNull()).select(F.col("root_id").alias("id"))
    return comments.where("root_id is null").join(own.union(replied).distinct(), "id", "left_semi")


# Statistics -----------------------------------------------------------------------------------------------------------


def reason_histogram(df: DataFrame, reason: str) -> DataFrame:
    return df.where(F.col(reason).isNotNull()).groupBy(reason).agg(F.count("*").alias("n"))


def source_quality(outcomes: DataFrame, source: str = "source") -> DataFrame:
    """Per source with three items or more: 10 staged / n - 3 rejected / n, to one digit, within 0 and 10."""
    n = outcomes.groupBy(source).agg(F.count("*").alias("processed"), F.count_if(F.col("outcome") == "staged").alias("staged"), F.count_if(F.col("outcome") == "low").alias("low"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    score = F.round(10.0 * F.col("staged") / F.col("processed") - 3.0 * F.col("rejected") / F.col("processed"), 1)
    return n.where("processed >= 3").withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def rolling_quality(scores: DataFrame, source: str, order: list[str], value: str, last: int = 42) -> DataFrame:
    """Mean of the last scores of a source, and whether it is to be retired."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(-(last - 1), 0)
    df = scores.withColumn("average", F.avg(value).over(w)).withColumn("n_scores", F.count("*").over(w))
    return df.withColumn("retire", (F.col("n_scores") >= 5) & (F.col("average") < 6))


def error_streaks(cycles: DataFrame, source: str, order: list[str], failed: Column) -> DataFrame:
    """Length of the run of failed cycles that ends at each cycle."""
    w = Window.partitionBy(source).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    df = cycles.withColumn("__failed", failed).withColumn("__island", island)
    streak = F.sum(F.when(F.col("__failed"), 1).otherwise(0)).over(Window.partitionBy(source, "__island").orderBy(*order))
    return df.withColumn("streak", streak).drop("__failed", "__island")


def health_level(failed: Column, total: Column) -> Column:
    return F.when((failed == total) & (total > 0), "all-failed").when(failed > 0, "partial").otherwise("none")


def capped_counter(events: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Uses per key, as far as the budget goes."""
    return events.groupBy(*keys).agg(F.count("*").alias("asked")).withColumn("granted", F.least("asked", F.lit(cap)))


def rate_limited(events: DataFrame, user: str, at: str, tie: str, seconds: int = 30) -> DataFrame:
    """Whether an event comes too soon after the user's one before."""
    before = F.lag(at).over(Window.partitionBy(user).orderBy(at, tie))
    return events.withColumn("limited", F.coalesce(F.col(at) - before < seconds, F.lit(False)))


def sessions(events: DataFrame, user: str, at: str, tie: str, gap: int = 60) -> DataFrame:
    """Runs of a user's events with no gap longer than so many seconds."""
    w = Window.partitionBy(user).orderBy(at, tie)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    df = events.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(user, "session").agg(F.count("*").alias("n_events"), F.min(at).alias("began"), F.max(at).alias("ended"))


def queue_state(transitions: DataFrame, key: str, at: str, tie: str, as_of: int, lease: int = 300, retries: int = 3) -> DataFrame:
    """State of each queued item from its log: the last event counts, a lease that ran out is pending again, too many failures discard."""
    last = transitions.groupBy(key).agg(F.max_by("state", F.struct(at, tie)).alias("state"), F.max(at).alias("since"), F.count_if(F.col("state") == "failed").alias("failures"))
    now = F.when(F.col("failures") >= retries, "discarded").when((F.col("state") == "processing") & (F.col("since") < as_of - lease), "pending").when(F.col("state") == "failed", "pending").otherwise(F.col("state"))
    return last.withColumn("state", now)


def apply_status(queue: DataFrame, changed: DataFrame, key: str, status: str) -> DataFrame:
    """The queue with a new status for the changed keys."""
    mark = changed.select(key).distinct().withColumn("__m", F.lit(True))
    return queue.join(mark, key, "left").withColumn("status", F.when(F.col("__m"), status).otherwise(F.col("status"))).drop("__m")


def without_expired(df: DataFrame, created: str, ttl: int, retained: Column, as_of: int, retained_ttl: int = 30 * 86400) -> DataFrame:
    """Rows that have not outlived their time; retained ones have longer."""
    return df.where(F.col(created) + F.when(retained, retained_ttl).otherwise(ttl) > as_of)


def daily_brief(items: DataFrame, day: str, order: list[Column], source_cap: int = 5) -> DataFrame:
    """One row a day with its ranked items as an array."""
    capped = top_per_group(items.withColumn("__src", F.concat_ws("\u0001", day, "source")), "__src", order, source_cap, "__k")
    ranked = capped.withColumn("rank", F.row_number().over(Window.partitionBy(day).orderBy(*order)))
    return ranked.groupBy(day).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.struct("rank", "id", "title", "source"))).alias("items"))


def brief_card(row: dict[str, Column], labels: dict[str, str] = fixed.CARD) -> Column:
    """A card of the brief in Markdown.

    row: title, contract (a change of contract), source, source_id, published, url, happened, definition, scene, practice, action;
    what is missing or empty leaves no line, but for title and source.  Of what happened the first two paragraphs are shown, 160
    characters each.
    """
    of = lambda name: text.trimmed(F.coalesce(row.get(name, F.lit(None)).cast("string"), F.lit("")))
    or_else = lambda c, other: F.when(c == "", other).otherwise(c)
    link = F.when(of("url") == "", fixed.CARD_NO_LINK).otherwise(F.concat(F.lit("["), of("url"), F.lit("]("), of("url"), F.lit(")")))
    head = F.concat(F.lit("### "), or_else(of("title"), F.lit(fixed.CARD_UNTITLED)), F.when(F.coalesce(row.get("contract", F.lit(False)), F.lit(False)), "\n" + fixed.CARD_CONTRACT).otherwise(""))
    parts = F.slice(F.filter(F.split(of("happened"), "\n+", -1), lambda x: x != ""), 1, 2)
    happened = F.array_join(F.transform(parts, lambda x: F.substring(text.trimmed(x), 1, 160)), " ")
    line = lambda name, c: F.when(c != "", F.concat(F.lit(f"- **{labels[name]}**："), c))
    traced = F.concat(or_else(of("source"), or_else(of("source_id"), F.lit(fixed.CARD_UNKNOWN))), F.lit(" · "), of("published"), F.lit(" · "), link)
    return F.concat_ws("\n", head, line("source", traced), line("happened", happened), *[line(n, of(n)) for n in ("definition", "scene", "practice", "action")])


def with_engagement(items: DataFrame, events: DataFrame, key: str, favourite: Column, browse: Column) -> DataFrame:
    """items with engagement: three a favourite and one a view of the events of their key; none is 0."""
    points = events.groupBy(F.col(key).alias("__k")).agg((F.count_if(favourite) * 3 + F.count_if(browse)).alias("__points"))
    return items.join(points, F.col(key) == F.col("__k"), "left").withColumn("engagement", F.coalesce("__points", F.lit(0))).drop("__k", "__points")


def unnested(briefs: DataFrame, items: str = "items") -> DataFrame:
    """The items of briefs as rows; a brief without items has none."""
    return briefs.select(F.explode(items).alias("__i")).where("__i is not null").select("__i.*")


def task_log(tasks: DataFrame, log: DataFrame, task: str, body: str, at: str, tie: str, newest: int = 3) -> DataFrame:
    """The newest log blocks that name each task, and their rank.

    A task's name is made of ASCII letters, digits and hyphens and counts only where none of these stands beside it, so
    a block names the tasks that equal one of its runs of such characters: an equal key, no comparison of all pairs.
    """
    named = log.select(at, tie, F.explode(F.array_distinct(F.regexp_extract_all(body, F.lit("([A-Za-z0-9-]+)")))).alias(task))
    return top_per_group(tasks.select(task).distinct().join(named, task), task, [F.desc(at), F.desc(tie)], newest)


def insert_absent(registry: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The registry and the seeds whose key it has not, each key once; what stands in the registry stays as it is.  Seeds of one key count as equal: any of them is taken."""
    new = seeds.where(F.col(key).isNotNull()).join(registry.select(key), key, "left_anti")
    return registry.unionByName(new.dropDuplicates([key]).select(*registry.columns))
