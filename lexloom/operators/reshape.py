"""Projections and reshaping of nested results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import exact_span
from ..functions.text import article_number, at_spans, blank, clean_markup, first_filled, resolution, short_hash, slug, squeeze, topic_slug
from ..functions.values import clip_spans, iso_date, span_bounds, span_text, spans_of

SIDES = ("head", "tail")


def explode_triples(df: DataFrame, triples: str, row_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each triple of the array column ``triples``, with its place (``triplet_index`` if it has one) and its source row."""
    rows = df.select(row_id, *keep, F.posexplode(triples).alias("pos", "t"))
    return rows.select(row_id, *keep, F.coalesce(F.col("t.triplet_index"), F.col("pos")).alias("place"), "pos", "t.*")


def renest_triples(original: DataFrame, flat: DataFrame, triples: str, row_id: str, fields: list[str], keep: Column | None = None) -> DataFrame:
    """Puts the triples of ``flat`` (``row_id``, ``pos``, ``fields``) back, in order; a row with none keeps its own, filtered by ``keep``.

    ``keep`` is a function of a triple's struct column, or None to keep all.
    """
    groups = flat.groupBy(row_id).agg(F.sort_array(F.collect_list(F.struct("pos", *fields))).alias("_new"))
    own = F.transform(F.filter(triples, keep) if keep is not None else F.col(triples), lambda t: F.struct(*(t[f].alias(f) for f in fields)))
    new = F.transform("_new", lambda t: F.struct(*(t[f].alias(f) for f in fields)))
    return original.join(groups, row_id, "left").withColumn(triples, F.coalesce(new, own)).drop("_new")


def sides(df: DataFrame, keys: list[str]) -> DataFrame:
    """Head and tail of each triple as rows of their own: ``role``, ``label``, ``type``."""
    parts = F.array(*(F.struct(F.lit(r).alias("role"), F.col(r).alias("label"), F.col(f"{r}_type").alias("type")) for r in SIDES))
    return df.select(*keys, F.explode(parts).alias("e")).select(*keys, "e.role", "e.label", "e.type")


def flatten(df: DataFrame, keys: list[str], text: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, entities and mentions of exploded triples, in one pass over them each; mentions are entities with a span."""
    entity = lambda r: F.struct(
        F.lit(r).alias("role"), F.col(r).alias("label"), F.col(f"{r}_type").alias("type"),
        (lambda s: clip_spans(s, F.length(text)) if text else s)(spans_of(F.col(f"{r}_spans"), F.col(f"{r}_start"), F.col(f"{r}_end"))).alias("spans"),
    )
    entities = df.select(*keys, F.explode(F.array(*map(entity, SIDES))).alias("e")).select(*keys, "e.*")
    start, end = span_bounds(F.col("spans"))
    mentions = entities.where(F.size("spans") > 0).withColumns({"start": start, "end": end})
    return df.select(*keys, "head", "head_type", "relation", "tail", "tail_type", "topic"), entities, mentions


# fixed values: columns of the flat tables, in order
CONTEXT = ("document_key", "article_id", "article_key", "article_number", "corpus_id", "date")
SPAN_FIELDS = ("start", "end", "spans", "span_text", "span_mode")
SIDE_COLUMNS = ("", "_type", "_resolution_mode", "_resolved_entity_id")
ENTITY_COLUMNS = ("entity", "entity_type", "entity_resolution_mode", "resolved_entity_id", "has_mention", "entity_start", "entity_end", "entity_spans", "entity_span_text", "entity_span_mode")
MENTION_COLUMNS = ("mention", "mention_type", "mention_resolution_mode", "resolved_entity_id", "mention_start", "mention_end", "mention_spans", "mention_text", "mention_span_mode")


def article_context(rows: DataFrame) -> DataFrame:
    """The context columns of result rows that are joined with their articles: the first that isn't blank of what article, provenance and text say.

    ``rows`` has of the article ``num``, ``id``, ``title``, ``corpus_id``, ``date``, of the provenance ``number``, ``id_local``, ``prov_title``, ``prov_corpus_id``, and ``article_id``,
    ``content`` and ``source_row_id``.
    """
    title = squeeze(first_filled(F.col("title"), F.col("prov_title"), F.col("corpus_id"), F.col("id"), default="document"))
    number = first_filled(F.col("num"), F.col("number"), squeeze(article_number(F.col("content"))))
    own = first_filled(F.col("id"), F.col("id_local"), F.col("article_id"))
    both = F.concat(own, F.lit("-"), F.col("source_row_id").cast("string"))
    made = {
        "document_key": F.concat(slug(title, 80, "document"), F.lit("-"), short_hash(title)), "_own": own, "article_key": first_filled(number, both), "article_number": number,
        "corpus_id": first_filled(F.col("corpus_id"), F.col("prov_corpus_id")), "date": iso_date(first_filled(F.col("date"))),
    }
    return rows.withColumns(made).withColumn("article_id", F.col("_own")).drop("_own")


def layouts(rows: DataFrame, triples: str, infer: bool = True, main_topic: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The flat tables of triples, entities and mentions, and a row that counts them and the heads and tails without a span.

    ``rows``: the CONTEXT columns, ``content``, and the array column ``triples``; ``main_topic`` stands in for a triple's topic. Spans are those of a triple,
    clipped to the text, else, if ``infer``, the first occurrence of the label, as it is or in any case. Offsets and spans are texts, empty where there are none.
    """
    flat = rows.select(*CONTEXT, "content", *([main_topic] if main_topic else []), F.posexplode(triples).alias("_pos", "_t"))
    text = lambda f: first_filled(F.col(f"_t.{f}"))
    flat = flat.select(
        "*", F.coalesce(F.col("_t.triplet_index"), F.col("_pos")).cast("string").alias("triplet_index"), text("relation").alias("relation"),
        first_filled(F.col("_t.topic"), *([F.col(main_topic)] if main_topic else [])).alias("topic"), *(text(f"{r}{x}").alias(f"{r}{x}") for r in SIDES for x in ("", "_type")),
    )
    for r in SIDES:
        own = clip_spans(spans_of(F.col(f"_t.{r}_spans"), F.col(f"_t.{r}_start"), F.col(f"_t.{r}_end")), F.length("content"))
        found = exact_span(F.col(r), F.col("content")) if infer else own
        mode, target = resolution(F.col(r), F.col(f"{r}_type"), F.col("document_key"))
        flat = flat.withColumns({"_own": own, "_found": found}).withColumn("_s", F.when(F.size("_own") > 0, F.col("_own")).otherwise(F.col("_found")))
        start, end = span_bounds(F.col("_s"))
        flat = flat.withColumns({
            f"{r}_resolution_mode": mode, f"{r}_resolved_entity_id": target, f"{r}_start": F.coalesce(start.cast("string"), F.lit("")), f"{r}_end": F.coalesce(end.cast("string"), F.lit("")),
            f"{r}_spans": span_text(F.col("_s"), "; "), f"{r}_span_text": F.trim(at_spans(F.col("content"), F.col("_s"))),
            f"{r}_span_mode": F.when(F.size("_own") > 0, "embedded").when(F.size("_s") > 0, "inferred").otherwise(""),
        }).drop("_own", "_found", "_s")
    sides_of = lambda r: [*(f"{r}{x}" for x in SIDE_COLUMNS)]
    spans_cols = lambda r: [f"{r}_{x}" for x in SPAN_FIELDS]
    triplets = flat.select(*CONTEXT, "triplet_index", *sides_of("head"), "relation", *sides_of("tail"), "topic", *spans_cols("head"), *spans_cols("tail"))
    has = lambda r: F.when(F.col(f"{r}_span_mode") != "", "true").otherwise("false")
    entity = lambda r: F.struct(F.lit(r).alias("entity_role"), *(c.alias(n) for c, n in zip([*map(F.col, sides_of(r)), has(r), *map(F.col, spans_cols(r))], ENTITY_COLUMNS)))
    entities = triplets.select(*CONTEXT, "triplet_index", F.explode(F.array(*map(entity, SIDES))).alias("e")).select(*CONTEXT, "triplet_index", "e.*")
    kept = [c for c in ENTITY_COLUMNS if c != "has_mention"]
    mentions = entities.where("has_mention = 'true'").select(*CONTEXT, "triplet_index", F.col("entity_role").alias("mention_role"), *(F.col(a).alias(b) for a, b in zip(kept, MENTION_COLUMNS)))
    missing = [F.count(F.when(F.col(f"{r}_span_mode") == "", 1)) for r in SIDES]
    n = F.count(F.lit(1))
    counts = triplets.agg(n.alias("triplets"), (n * 2).alias("entities"), (n * 2 - missing[0] - missing[1]).alias("mentions"), missing[0].alias("missing_head_spans"), missing[1].alias("missing_tail_spans"))
    return triplets, entities, mentions, counts


def expand_refs(df: DataFrame, default_refs: str = "refs", dated_refs: str | None = None) -> DataFrame:
    """A row for each reference: map<num, struct<id, content>>, or map<date, array<struct<CID, Title, Articles>>> with a row for each of its articles.

    Empty maps and lists still give one row.
    """
    if dated_refs is None:
        rows = df.select("*", F.explode_outer(default_refs).alias("num", "_r"))
        return rows.withColumns({"ref_id": F.col("_r.id"), "content": F.col("_r.content")}).drop("_r", default_refs)
    rows = df.select("*", F.explode_outer(dated_refs).alias("date", "_d")).select("*", F.explode_outer("_d").alias("_t"))
    rows = rows.withColumns({"corpus_id": F.col("_t.CID"), "title": F.col("_t.Title")}).select("*", F.explode_outer("_t.Articles").alias("_a"))
    return rows.withColumns({"chapter_title": F.col("_a.chapterTitle"), "content": F.col("_a.content")}).drop("_d", "_t", "_a", dated_refs)


def content_counts(df: DataFrame, content: str, tokens) -> DataFrame:
    """Cleaned text with its counts of characters and tokens; ``tokens`` is a function of a column."""
    clean = clean_markup(F.col(content))
    return df.withColumn(content, clean).withColumns({"content_char_count": F.length(content), "content_token_count": tokens(F.col(content))})


def topics(df: DataFrame, domain: str, key: str) -> DataFrame:
    """``key``, ``topic_label``, ``topic_slug`` for each topic of a cell that holds one name or a list literal; blank names are left out."""
    cell = F.trim(domain)
    names = F.when(F.startswith(cell, F.lit("[")), F.regexp_extract_all(cell, F.lit(r"""'([^']*)'|"([^"]*)\""""), F.lit(0))).otherwise(F.array(cell))
    rows = df.select(key, F.explode(names).alias("topic_label"))
    rows = rows.withColumn("topic_label", F.trim(F.regexp_replace("topic_label", r"""^['"]|['"]$""", "")))
    return rows.where(~blank(F.col("topic_label"))).withColumn("topic_slug", topic_slug(F.col("topic_label"))).distinct()


def compact_json(df: DataFrame, key: str, order: str, fields: dict[str, str]) -> DataFrame:
    """A group's rows as one JSON array of objects with short keys, for a prompt."""
    item = F.struct(F.col(order).alias("_o"), *(F.col(c).alias(k) for k, c in fields.items()))
    packed = df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    return packed.select(key, F.to_json(F.transform("_rows", lambda r: F.struct(*(r[k].alias(k) for k in fields)))).alias("payload"))


def assign_by_place(df: DataFrame, topics_by_place: DataFrame, keys: list[str]) -> DataFrame:
    """Topics from a table of (``keys``, topic); rows without one keep theirs."""
    named = topics_by_place.withColumnRenamed("topic", "_topic")
    return df.join(named, keys, "left").withColumn("topic", F.coalesce("_topic", "topic")).drop("_topic")


def batches(df: DataFrame, key: str, order: list[str], size: int, item: Column) -> DataFrame:
    """Batches of ``size`` rows within each key, in order: ``key``, ``batch``, ``items``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    rows = df.withColumn("_n", nth).withColumn("batch", F.floor(F.col("_n") / size))
    packed = rows.groupBy(key, "batch").agg(F.sort_array(F.collect_list(F.struct("_n", item.alias("item")))).alias("_i"))
    return packed.select(key, "batch", F.col("_i.item").alias("items"))


def provenance(df: DataFrame, provider: str, model: str, **extra: str) -> DataFrame:
    run = F.lit(f"relationExtractionRun_{provider}_{model}")
    return df.withColumns({"provider": F.lit(provider), "model": F.lit(model), "run_id": run} | {k: F.lit(v) for k, v in extra.items()})


def class_hints(name: Column, classes: list[str]) -> Column:
    """The classes whose names occur in ``name``, in any case, in their order."""
    return F.filter(F.array(*map(F.lit, classes)), lambda c: F.contains(F.lower(name), F.lower(c)))
