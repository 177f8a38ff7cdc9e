"""Products by name: an index of letter groups, substring search by it, and confident answers.

A product holds a word as a substring only if it holds all of the word's groups
of three letters, so one equi join on the word's rarest group finds all
candidates and ``contains`` confirms them; nothing scans the catalog per query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.operators import matching
from marketloom.operators.search import content_words, words
from marketloom.sources.work import spread, written

GROUP = 3  # letters of a group


def letter_groups(text: Column, sizes: tuple[int, ...] = (1, 2, GROUP)) -> Column:
    """The distinct groups of neighbouring letters of a text, of each size."""

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.when(F.length(text) >= n, F.transform(places, lambda i: F.substr(text, i, F.lit(n))))

    return F.array_distinct(F.flatten(F.array_compact(F.array(*map(of_size, sizes)))))


@dataclass(frozen=True)
class NameIndex:
    """Products with the number of their folded name (text), those names (text, norm), the names of every letter group (grp, text), and how many each has (grp, n)."""

    products: DataFrame
    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def name_index(products: DataFrame) -> NameIndex:
    """An index of products (id, name, ...), written once for any number of searches; null names are empty, equal names are indexed once."""
    rows = products.withColumn("norm", F.array_join(words(F.col("name")), " "))
    texts = written(rows.groupBy("norm").agg(F.min("id").alias("text")))
    postings = written(spread(texts, "text").select("text", F.explode(letter_groups(F.col("norm"))).alias("grp")))
    return NameIndex(written(rows.join(texts, "norm")), texts, postings, written(postings.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))))


def _texts(index: NameIndex, needles: DataFrame) -> DataFrame:
    """(request_id, text): the folded names that hold every string of a request."""
    asked = needles.where("needle is not null and needle <> ''").distinct()
    size = F.least(F.length("needle"), F.lit(GROUP))
    own = F.transform(F.sequence(F.lit(1), F.length("needle") - size + 1), lambda i: F.substr(F.col("needle"), i, size))
    groups = asked.select("request_id", F.explode(F.array_distinct(own)).alias("grp")).distinct()
    rarity = groups.join(index.counts, "grp", "left").groupBy("request_id")
    rarest = rarity.agg(F.min_by("grp", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "grp")).alias("grp"))
    wanted = rarest.join(asked.groupBy("request_id").agg(F.collect_set("needle").alias("needles")), "request_id")
    pairs = wanted.join(index.postings, "grp").join(index.texts, "text")
    return pairs.where(F.forall("needles", lambda x: F.contains(F.col("norm"), x))).select("request_id", "text")


def containing(index: NameIndex, needles: DataFrame) -> DataFrame:
    """(request_id, id): products whose folded names hold every string of a request as a substring; needles: request_id, needle.

    Of all groups of all strings of a request the one that the fewest names
    have is looked up.  Requests with an empty or null string have no rows for it;
    equal rows count once.
    """
    return _texts(index, needles).join(index.products.select("id", "text"), "text").select("request_id", "id")


def anchors(text: Column) -> Column:
    """The first two words of a text that can anchor a search: three letters or more, no digit, no stop word."""
    return F.slice(F.filter(content_words(text), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]")), 1, 2)


def name_lookup(index: NameIndex, requests: DataFrame, eligible: DataFrame) -> DataFrame:
    """One answer per request: request_id, status, product_id, score_bp, reason.

    requests: request_id, name, size_text (may be null), unit and unit_size as
    read from both; the index's products need brand, section, unit, unit_size and
    may have ean; ``eligible`` has the ids of products that may be answered.  The
    candidate with the best score of ``matching.decide`` counts, on ties the
    smallest id; the status is confident from the automatic band on, else review
    or none, and only a confident answer names its product.  Requests without a
    usable word are none, reason no-usable-tokens; without a candidate,
    no-candidate.
    """
    text = F.concat_ws(" ", "name", "size_text")
    asked = requests.select("request_id", "name", "unit", "unit_size", anchors(text).alias("words"))
    found = _texts(index, asked.select("request_id", F.explode("words").alias("needle")))
    sides = {"name": "name", "brand": "brand", "unit": "unit", "unit_size": "size"}
    ean = F.col("ean") if "ean" in index.products.columns else F.lit(None).cast("string")
    # of products that read alike only the one with the smallest id can be the answer
    known = index.products.where("unit is not null and unit_size is not null").join(eligible.select("id").distinct(), "id", "left_semi")
    grocery = F.when(F.col("section") == "grocery", "grocery").alias("section")
    known = known.groupBy("text", grocery, *(F.col(c).alias(f"c_{n}") for c, n in sides.items()), ean.alias("c_ean")).agg(F.min("id").alias("id"))
    mine = asked.select("request_id", F.col("name").alias("s_name"), F.lit("").alias("s_brand"), F.col("unit").alias("s_unit"), F.col("unit_size").alias("s_size"), F.lit(None).cast("string").alias("s_ean"))
    pairs = found.join(matching.described(known, "c"), "text").join(matching.described(mine, "s"), "request_id")
    scored = matching.decide(spread(pairs, "request_id", "id"))
    # the highest score, then the smallest id, then what was said about it
    best = scored.groupBy("request_id").agg(F.max(F.struct("score_bp", (-F.col("id")).alias("back"), "reason")).alias("b"))
    best = best.select("request_id", F.col("b.score_bp"), (-F.col("b.back")).alias("id"), F.col("b.reason").alias("why"))
    score = F.coalesce("score_bp", F.lit(0))
    status = F.when(score >= C.AUTO_BAND * 10_000, "confident").when(score >= C.REVIEW_BAND * 10_000, "review").otherwise("none")
    reason = F.when(F.size("words") == 0, "no-usable-tokens").otherwise(F.coalesce("why", F.lit("no-candidate")))
    out = asked.join(best, "request_id", "left")
    return out.select("request_id", status.alias("status"), F.when(status == "confident", F.col("id")).alias("product_id"), score.cast("long").alias("score_bp"), reason.alias("reason"))
