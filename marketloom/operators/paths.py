"""Category paths that merchants state: recovered from offers, and assigned to leaves of the own tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import scalars as S
from marketloom.functions.grammar import let
from marketloom.operators import taxonomy
from marketloom.sources.work import written

# fixed values: url parts behind which no category follows
URL_MARKERS = ["p", "c", "produs", "product"]
# fixed values: words of a path level that say nothing about its place
PATH_FILLER = ["produse", "si", "de", "la", "din", "cu", "pentru", "alte", "altele"]
CATCH_ALL = "-altele"


def _parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


def from_listed_paths(payload: Column, key: str = "categories") -> Column:
    """Levels of the longest of the paths that a payload lists under ``key``, the first of several.

    The payload may be cut off anywhere behind the list, so it is read as text.
    """
    listed = F.regexp_extract(payload, rf'"{key}"\s*:\s*\[([^\]]*)\]', 1)
    paths = F.transform(F.regexp_extract_all(listed, F.lit('"([^"]+)"'), F.lit(1)), _parts)
    longest = F.array_max(F.transform(paths, lambda p, i: F.struct(F.size(p).alias("n"), (-i).alias("back"), p.alias("levels"))))
    return longest["levels"]


def from_url_folders(url: Column, markers: list[str] | None = None) -> Column:
    """Levels of a product url: the folders before a marker part, without the product's own."""
    marks = F.array(*(F.lit(m) for m in markers or URL_MARKERS))

    def folders(parts: Column) -> Column:
        at = F.array_position(F.transform(parts, lambda p: F.array_contains(marks, F.lower(p))), F.lit(True))
        head = let(at, lambda n: F.when(n > 1, F.slice(parts, F.lit(1), (n - 1).cast("int"))).otherwise(parts))
        own = let(head, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0))))
        return F.transform(own, lambda p: F.replace(p, F.lit("-"), F.lit(" ")))

    return let(_parts(F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")), folders)


def from_breadcrumbs(payload: Column) -> Column:
    """The names of a payload's breadcrumbs; null where it is no whole JSON."""
    crumbs = F.from_json(payload, "breadcrumbs array<struct<name:string>>")["breadcrumbs"]
    return F.filter(F.transform(crumbs, lambda b: F.trim(b["name"])), lambda x: F.coalesce(x != "", F.lit(False)))


def from_stored_path(path: Column) -> Column:
    """Levels of a stored path, its dashes and underscores as spaces."""
    return F.filter(F.transform(_parts(path), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[-_]+", " "), r"\s+", " "))), lambda x: x != "")


def recovered(offers: DataFrame, kinds: DataFrame) -> DataFrame:
    """``offers`` with levels (array<string>) and path_source, both null where the merchant stated no category.

    offers: merchant_id, payload, url, category_path and more; kinds: merchant_id,
    kind, one of listed-paths, url-folders, breadcrumbs or stored-path; merchants
    without a kind are read by their stored path.
    """
    rows = offers.join(kinds.select("merchant_id", "kind").dropDuplicates(["merchant_id"]), "merchant_id", "left")
    readers = {"listed-paths": from_listed_paths(F.col("payload")), "url-folders": from_url_folders(F.col("url")), "breadcrumbs": from_breadcrumbs(F.col("payload"))}
    levels = from_stored_path(F.col("category_path"))
    for kind, reader in readers.items():
        levels = F.when(F.col("kind") == kind, reader).otherwise(levels)
    rows = rows.withColumn("levels", let(levels, lambda x: F.when(F.size(x) > 0, x)))
    source = F.when(F.col("levels").isNotNull(), F.coalesce("kind", F.lit("stored-path")))
    return rows.withColumn("path_source", source).drop("kind")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """(levels) of all distinct paths that are there, written once: they are few, and those who read them would each read every offer's text again."""
    return written(paths.select("levels").distinct()).where("levels is not null")


def level_keys(levels: Column) -> Column:
    """Folded levels, empty ones left out."""
    return F.filter(F.transform(levels, lambda x: S.normalize(x, glue_storage=False)), lambda x: x != "")


def path_key(levels: Column) -> Column:
    """A stable key of a path."""
    return F.array_join(level_keys(levels), " / ")


def prefixes(keys: Column) -> Column:
    """Array of (depth, prefix) of all non-empty prefixes of folded levels."""
    return F.transform(F.when(F.size(keys) > 0, F.sequence(F.lit(1), F.size(keys))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(keys, F.lit(1), n), " / ").alias("prefix")))


def path_trie(mapped: DataFrame) -> DataFrame:
    """The nodes of the trie of paths with a known leaf: prefix, depth, leaf, department, paths.

    mapped: levels, leaf, department.  A node has the leaf, and the department,
    on which all paths through it agree; else null.  Paths repeat as often as they like.
    """
    rows = mapped.select(level_keys(F.col("levels")).alias("keys"), "leaf", "department").groupBy("keys", "leaf", "department").agg(F.count(F.lit(1)).alias("n"))
    nodes = rows.select(F.inline(prefixes(F.col("keys"))), "leaf", "department", "n")
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    return nodes.groupBy("prefix", "depth").agg(one("leaf"), one("department"), F.sum("n").alias("paths"))


def by_longest_prefix(paths: DataFrame, trie: DataFrame) -> DataFrame:
    """(levels, leaf, department, depth, band) of every distinct path.

    The deepest prefix that the trie gives a leaf for: AUTO.  Where there is none, the
    deepest that it gives a department for: REVIEW, without a leaf.  Else NONE, depth 0.
    Null paths are left out.
    """
    rows = distinct_paths(paths)
    hits = rows.select("levels", F.inline(prefixes(level_keys(F.col("levels"))))).join(trie.drop("depth", "paths"), "prefix")
    rank = F.struct(F.col("leaf").isNotNull().alias("whole"), "depth")
    best = hits.where("leaf is not null or department is not null").groupBy("levels").agg(F.max_by(F.struct("leaf", "department", "depth"), rank).alias("b"))
    out = rows.join(best, "levels", "left")
    band = F.when(F.col("b.leaf").isNotNull(), "AUTO").when(F.col("b.department").isNotNull(), "REVIEW").otherwise("NONE")
    return out.select("levels", F.col("b.leaf").alias("leaf"), F.col("b.department").alias("department"), F.coalesce("b.depth", F.lit(0)).alias("depth"), band.alias("band"))


def named_departments(levels: DataFrame, departments: DataFrame) -> DataFrame:
    """(level, department) of level texts that name a department: that hold all words of its label, or of its slug.

    departments: department (slug), label, place; the first by place counts.
    Words of PATH_FILLER do not count.
    """
    filler = F.array(*(F.lit(w) for w in PATH_FILLER))
    own = lambda text: F.array_distinct(F.array_except(S.tokens(S.normalize(text, glue_storage=False)), filler))
    names = F.array(own(F.col("label")), own(F.replace("department", F.lit("-"), F.lit(" "))))
    needs = departments.select("department", "place", F.posexplode(names).alias("form", "need")).where(F.size("need") > 0)
    words = levels.select("level").distinct().select("level", F.explode(own(F.col("level"))).alias("word"))
    held = needs.select("department", "place", "form", F.size("need").alias("n"), F.explode("need").alias("word")).join(words, "word")
    held = held.groupBy("level", "department", "place", "form", "n").agg(F.count(F.lit(1)).alias("have")).where("have = n")
    return held.groupBy("level").agg(F.min_by("department", "place").alias("department"))


def assign_by_path(paths: DataFrame, rules: DataFrame, departments: DataFrame) -> DataFrame:
    """(levels, leaf, department, score, band, reason) of every distinct path, by what its levels are called.

    Levels are read from the deepest outwards.  One that names a department is
    noted and skipped; the first other one that ``taxonomy.assign_by_name`` with
    ``rules`` gives a category at review score or better decides: AUTO, as the
    merchant said so.  A path of departments alone goes to the catch-all leaf of
    its deepest one; any other has no leaf, band NONE.
    """
    rows = distinct_paths(paths).withColumn("path", F.col("levels"))
    each = rows.select("path", F.posexplode("levels").alias("depth", "level"))
    named = named_departments(each, departments)
    other = each.select("level").distinct().join(named, "level", "left_anti").select(F.col("level").alias("id"), F.col("level").alias("name"))
    placed = taxonomy.assign_by_name(other, rules).where(F.col("score") >= C.REVIEW_BAND * 100)
    home = rules.select(F.col("category").alias("leaf"), F.col("department").alias("leaf_department")).distinct()
    placed = placed.select(F.col("id").alias("level"), F.col("category").alias("leaf"), "score").join(home, "leaf")
    facts = each.join(named, "level", "left").join(placed, "level", "left")
    by_leaf = F.max_by(F.struct("leaf", "leaf_department", "score", "level"), F.when(F.col("leaf").isNotNull(), F.col("depth")))
    by_department = F.max_by("department", F.when(F.col("department").isNotNull(), F.col("depth")))
    best = facts.groupBy("path").agg(by_leaf.alias("l"), by_department.alias("d"))
    least = F.lit(round(C.AUTO_BAND * 100))
    leaf = F.coalesce("l.leaf", F.concat("d", F.lit(CATCH_ALL)))
    score = F.when(F.col("l.leaf").isNotNull(), F.greatest("l.score", least)).when(F.col("d").isNotNull(), least).otherwise(0)
    reason = F.when(F.col("l.leaf").isNotNull(), F.concat(F.lit("level "), "l.level")).when(F.col("d").isNotNull(), "department").otherwise("unmapped")
    return best.select(
        F.col("path").alias("levels"), leaf.alias("leaf"), F.coalesce("l.leaf_department", "d").alias("department"), score.cast("int").alias("score"),
        F.when(leaf.isNotNull(), "AUTO").otherwise("NONE").alias("band"), reason.alias("reason"),
    )


def path_frequency(rows: DataFrame) -> DataFrame:
    """Offers per merchant and path key, most frequent first within a merchant."""
    counts = rows.where("levels is not null").groupBy("merchant_id", path_key(F.col("levels")).alias("path")).agg(F.count(F.lit(1)).alias("offers"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("merchant_id").orderBy(F.desc("offers"), "path")))
