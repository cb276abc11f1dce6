"""Version rows of sections, and pages with the section links they list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank


def latest_versions(rows: DataFrame, order: str) -> DataFrame:
    """(part, identifier, name, order): of each section the last row by ``order`` that is substantive and not removed.

    Rows of another type, or without identifier, don't count; a null
    ``substantive`` is true and a null ``removed`` false.  What was removed or
    unsubstantive goes first, so an older live row stands again.
    """
    live = (F.col("type") == "section") & F.coalesce("substantive", F.lit(True)) & ~F.coalesce("removed", F.lit(False)) & (F.trim(blank(F.col("identifier"))) != "")
    rows = rows.where(live).select("part", F.trim("identifier").alias("identifier"), F.trim(blank(F.col("name"))).alias("name"), order)
    last = F.row_number().over(Window.partitionBy("part", "identifier").orderBy(F.desc(order)))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n")


def section_links(pages: DataFrame, key: str, html: str, part: str, base: str) -> DataFrame:
    """(key, part, url, pos): links to sections of a page's ``part`` (a column), each once, by its first place.

    A link to ``/section-<part>.n`` counts without its fragment; an anchor
    ``#<part>.n`` becomes ``<base>/section-<part>.n``.
    """
    found = pages.select(key, F.col(part).alias("part"), F.posexplode(F.regexp_extract_all(blank(F.col(html)), F.lit(r"(?i)href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("pos", "href"))
    path = F.regexp_replace("href", "#.*$", "")
    section = F.regexp_extract("href", r"^#(\d+\.\d+\b.*)$", 1)
    listed = F.regexp_extract(path, r"/section-(\d+)\.\d+$", 1) == F.col("part")
    whole = F.when(path.rlike("^[a-z]+://"), path).otherwise(F.concat(F.lit(base), path))
    url = F.when(listed, whole).when(F.substring_index(section, ".", 1) == F.col("part"), F.concat(F.lit(base + "/section-"), section))
    return found.select(key, "part", "pos", url.alias("url")).where("url is not null").groupBy(key, "part", "url").agg(F.min("pos").alias("pos"))


def changes(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, old_hash, new_hash, change): what became of each key: added, removed, changed or same.

    Contents are compared by their SHA-256, null as empty; both sides have each
    key once, and null keys don't count.
    """
    hashed = lambda rows, name: rows.where(F.col(key).isNotNull()).select(key, F.sha2(blank(F.col(content)), 256).alias(name))
    both = hashed(old, "old_hash").join(hashed(new, "new_hash"), key, "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("same")
    return both.withColumn("change", change)


#: When a version of a row began to hold, and when it ended: null while it holds.
SPAN = ("valid_from", "valid_to")


def _hashed(rows: DataFrame, content: list[str]) -> DataFrame:
    """A hash of the content that tells null from ''."""
    return rows.withColumn("content_hash", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))


def begin_versions(rows: DataFrame, keys: list[str], content: list[str], at: Column) -> DataFrame:
    """A history without any version, of the columns that ``merge_versions`` takes and gives."""
    empty = _hashed(rows.select(*keys, *content).limit(0), content)
    return empty.withColumns({SPAN[0]: at, SPAN[1]: F.lit(None).cast(empty.select(at.alias("t")).schema["t"].dataType)})


def merge_versions(history: DataFrame, batch: DataFrame, keys: list[str], content: list[str], at: Column, order: str | None = None, complete: bool = False, deleted: str | None = None) -> DataFrame:
    """``history`` after a batch of writes at the time ``at``: (keys, content, content_hash, valid_from, valid_to).

    Of a key's writes the last by ``order`` counts (of equal ones the greatest;
    without ``order`` the greatest content), and keys of which any part is null or
    blank are skipped.  Content is compared by its hash: an equal one leaves the
    version that holds as it is, another closes it and opens a new one.  A key
    whose last write has ``deleted`` ends; with ``complete``, so does each that the
    batch doesn't have.  Closed versions stay; each key has one open version at
    most, and both tables meet once, by their keys.
    """
    for k in keys:
        batch = batch.where(F.trim(F.col(k).cast("string")) != "")
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
    write = F.struct(*([F.col(order)] if order else []), *[F.col(c).alias(f"c_{c}") for c in content], gone.alias("gone"))
    last = batch.groupBy(*keys).agg(F.max(write).alias("w")).select(*keys, *[F.col(f"w.c_{c}").alias(c) for c in content], F.col("w.gone").alias("_gone"))
    row = [*content, "content_hash", *SPAN]
    new = _hashed(last, content).withColumns({SPAN[0]: at, SPAN[1]: F.lit(None).cast(history.schema[SPAN[1]].dataType)})
    new = new.select(*keys, F.struct(*row).alias("new"), "_gone")
    holds = history.where(F.col(SPAN[1]).isNull()).select(*keys, F.struct(*row).alias("old"))
    both = holds.join(new, keys, "full")
    same = F.col("old.content_hash") == F.col("new.content_hash")
    ends = F.col("old").isNotNull() & (F.coalesce(F.col("_gone"), F.lit(complete)) | (F.col("new").isNotNull() & ~same))
    begins = F.col("new").isNotNull() & ~F.col("_gone") & (F.col("old").isNull() | ~same)
    closed = F.struct(*[(at.alias(c) if c == SPAN[1] else F.col(f"old.{c}").alias(c)) for c in row])
    old = F.when(ends, closed).otherwise(F.col("old"))
    rows = F.filter(F.array(old, F.when(begins, F.col("new"))), lambda x: x.isNotNull())
    merged = both.select(*keys, F.explode(rows).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in row])
    return history.where(F.col(SPAN[1]).isNotNull()).select(*keys, *row).unionByName(merged)


def versions_at(history: DataFrame, at: Column) -> DataFrame:
    """The versions that held at a time; of one that began then and one that ended then, the one that began."""
    return history.where((F.col(SPAN[0]) <= at) & (F.col(SPAN[1]).isNull() | (F.col(SPAN[1]) > at)))
