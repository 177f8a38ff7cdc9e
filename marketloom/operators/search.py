"""Catalog search over many queries at once: correction, required words, tiers and scores.

A query's words are corrected against the catalog's own vocabulary; what cannot
be matched is reported, not dropped.  Products must hold every resolved word:
products that read alike are one row, which a query meets on its rarest word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.functions import prices
from marketloom.functions import scalars as S
from marketloom.sources.work import written

PREFIX = 8  # letters of a word that its keys are made of


def words(text: Column) -> Column:
    """Words of a folded text, in order."""
    return S.tokens(S.normalize(text, glue_storage=False))


def content_words(text: Column) -> Column:
    """Words without the stop words."""
    return F.filter(words(text), lambda w: ~w.isin(C.STOPWORDS))


def lead_word(name: Column) -> Column:
    """First word of three letters or more that is no stop word and has no digit; else empty."""
    return F.coalesce(F.get(F.filter(content_words(name), lambda w: (F.length(w) >= 3) & ~w.rlike("[0-9]")), F.lit(0)), F.lit(""))


def _hay() -> Column:
    return F.array_distinct(words(F.concat_ws(" ", F.coalesce("brand", F.lit("")), "name")))


def cut_short(word: Column) -> Column:
    """A word's first PREFIX letters without up to two of them (one, for words of three letters or fewer): keys of a symmetric-delete index.

    Words within two edits of each other, a swap of neighbours being one, share
    a key: each edit takes at most one letter from either prefix.
    """
    first = F.substring(word, 1, PREFIX)
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    once = F.array_distinct(without(first))
    twice = F.when(F.length(word) > 3, F.flatten(F.transform(once, lambda w: without(w)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(first), once, twice))


@dataclass(frozen=True)
class Index:
    """Vocabulary (token, products), leading words (head, products), the catalog's brand words (token), and the keys of ``cut_short`` of the first two (token, key; head, key)."""

    vocab: DataFrame
    heads: DataFrame
    brands: DataFrame
    vocab_keys: DataFrame
    head_keys: DataFrame

    def kept(self) -> Index:
        """The same, written once, for searches that read it several times."""
        vocab, heads = written(self.vocab), written(self.heads)
        return Index(vocab, heads, written(self.brands), written(_keyed(vocab, "token")), written(_keyed(heads, "head")))


def _keyed(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().select(column, F.explode(cut_short(F.col(column))).alias("key"))


def index(products: DataFrame, known_brands: list[str] | None = None) -> Index:
    """What searches need of the catalog (name, brand); equal names of a brand are read once.

    A word of a brand counts as a brand if it has three letters or more, is no
    placeholder or number, and leads fewer than BRAND_HEADS names; words of
    ``known_brands`` count where the catalog uses them at all.
    """
    texts = products.groupBy("name", "brand").agg(F.count(F.lit(1)).alias("k"))
    vocab = texts.select("k", F.explode(_hay()).alias("token")).groupBy("token").agg(F.sum("k").alias("products"))
    heads = texts.groupBy(lead_word(F.col("name")).alias("head")).agg(F.sum("k").alias("products")).where("head <> ''")
    named = texts.select(F.explode(words(F.col("brand"))).alias("token")).distinct()
    named = named.where((F.length("token") >= 3) & ~F.col("token").isin(C.NOT_BRANDS) & ~F.col("token").rlike("^[0-9]+$"))
    common = heads.where(F.col("products") >= C.BRAND_HEADS).select(F.col("head").alias("token"))
    brands = named.join(common, "token", "left_anti")
    if known_brands:
        brands = brands.union(vocab.where(F.col("token").isin(known_brands)).select("token")).distinct()
    return Index(vocab, heads, brands, _keyed(vocab, "token"), _keyed(heads, "head"))


def similar(left: DataFrame, keys: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, sim) of words within the edit budget of the longer one; a swap of neighbours is one edit; keys: b and its ``cut_short`` keys.

    Words meet on a key, Levenshtein distance (a swap is two) rules more pairs
    out inside the JVM, and the rest are measured in Arrow batches.
    """
    rows = _keyed(left, a).join(keys.select(F.col(keys.columns[0]).alias(b), "key"), "key").select(a, b).distinct()
    rows = rows.where((F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b, 4) >= 0))
    longer = F.greatest(F.length(a), F.length(b))
    budget = F.when(longer <= 2, 0).when(longer <= 5, 1).otherwise(2)
    rows = rows.withColumn("d", prices.osa_distance(F.col(a), F.col(b))).where(F.col("d") <= budget)
    return rows.select(a, b, (1 - F.col("d") / longer).alias("sim"))


def correct(tokens: DataFrame, found: Index, known_brands: list[str] | None = None) -> DataFrame:
    """(token, corrected) of distinct query words; corrected is null where the catalog has nothing like it.

    A word used more than RARE_MAX times stays, and so do short words, words
    with digits and known brands that the catalog uses.  Others become the most
    similar word, the commonest of equals; a rare one only if that is DOMINANCE
    times as common.
    """
    own = tokens.select("token").distinct().join(found.vocab, "token", "left").select("token", F.coalesce("products", F.lit(0)).alias("own"))
    fixed = (F.length("token") < 3) | F.col("token").rlike("[0-9]") | F.col("token").isin(known_brands or [])
    open_ = own.where((F.col("own") <= C.RARE_MAX) & ~fixed)
    vocab = found.vocab.select(F.col("token").alias("near"), "products")
    close = similar(open_, found.vocab_keys, "token", "near").where("token <> near").join(vocab, "near")
    best = close.groupBy("token").agg(F.min_by(F.struct("near", "products"), F.struct(-F.col("sim"), -F.col("products"), F.col("near"))).alias("best"))
    rows = own.join(best, "token", "left")
    common = (F.col("best.products") >= F.col("own") * C.DOMINANCE) & (F.col("best.products") >= C.DOMINANCE)
    instead = F.when((F.col("own") == 0) | common, F.col("best.near"))
    return rows.select("token", F.coalesce(instead, F.when(F.col("own") > 0, F.col("token"))).alias("corrected"))


def _classes(products: DataFrame, first: int | None = None, kind: tuple[str, ...] = ("name", "brand", "category")) -> DataFrame:
    """Products that agree in ``kind`` as one row (cls): how many (n), or the ``first`` of them by shops and id."""
    if first is None:
        rows = products.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"))
    else:
        place = F.row_number().over(Window.partitionBy(*kind).orderBy(F.desc("merchants"), "id"))
        rows = products.select(*kind, "merchants", "id", place.alias("place")).where(F.col("place") <= first)
        rows = rows.groupBy(*kind).agg(F.array_sort(F.collect_list(F.struct("place", "merchants", "id"))).alias("first"))
    return written(rows.withColumn("cls", F.monotonically_increasing_id()))


def _shown(rows: DataFrame, classes: DataFrame, limit: int, *first: Column) -> DataFrame:
    """The products of the classes found (qid, cls), ``limit`` a query: by ``first``, then shops, name and id."""
    order = Window.partitionBy("qid").orderBy(*first, F.desc("merchants"), "name", "id")
    placed = lambda found: found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    best = placed(rows.join(classes.select("cls", "name", F.inline(F.slice("first", 1, 1))), "cls"))  # a class whose first comes later has none to show
    return placed(best.select(*rows.columns, "name").join(classes.select("cls", F.inline("first")), "cls"))


def _matched(classes: DataFrame, asked: DataFrame, found: Index) -> DataFrame:
    """Classes holding all words of each query (qid, words, required), with tier and score."""
    facts = classes.select(
        "cls", S.normalize(F.col("name"), glue_storage=False).alias("norm"), words(F.col("category")).alias("cat"), lead_word(F.col("name")).alias("head"),
        F.size(F.filter(F.array_distinct(words(F.col("name"))), lambda w: ~w.isin(C.STOPWORDS) & ~w.rlike("^[0-9]"))).alias("name_size"),
    )
    keyed = classes.select("cls", _hay().alias("hay")).select("cls", "hay", F.explode("hay").alias("token"))
    wanted = asked.select("qid", F.explode(F.array_distinct("words")).alias("token"))
    used = wanted.join(found.vocab, "token", "left").withColumn("products", F.coalesce("products", F.lit(0)))
    rarest = used.groupBy("qid").agg(F.min(F.struct("products", "token"))["token"].alias("token")).join(asked.select("qid", "words"), "qid")
    hits = rarest.join(keyed, "token").where(F.size(F.array_except("words", "hay")) == 0).select("qid", "cls")
    alike = similar(wanted, found.head_keys, "token", "head")
    heads = wanted.join(alike, "token").groupBy("qid", "head").agg(F.max("sim").alias("sim"))
    rows = hits.join(facts, "cls").join(asked, "qid").join(heads, ["qid", "head"], "left")
    phrase = F.array_join("words", " ")
    tier = (
        F.when(F.col("norm") == phrase, 400).when(F.contains("norm", phrase), 300)
        .when(F.size("required") > 0, 200).when(F.arrays_overlap("cat", "words"), 100).otherwise(0)
    )
    about = F.when(F.col("name_size") > 0, F.least(F.lit(1.0), F.size("words") / F.greatest("name_size", F.lit(C.SPECIFICITY_FLOOR)))).otherwise(0.0)
    score = 1 + 0.6 * F.coalesce("sim", F.lit(0.0)) + C.SPECIFICITY_WEIGHT * about
    return rows.select("qid", "cls", tier.alias("tier"), S.half_up(score * 10000).alias("score_bp")).where(F.col("score_bp") >= C.SEARCH_MIN_SCORE * 10000)


def _resolved(queries: DataFrame, found: Index, known_brands: list[str] | None) -> DataFrame:
    """Per query: words (as corrected), required brand words, missing ones, number of corrections."""
    tokens = queries.select("qid", F.posexplode_outer(content_words(F.col("query"))).alias("pos", "token"))
    fixed = correct(tokens.where("token is not null"), found, known_brands)
    brands = found.brands.select(F.col("token").alias("corrected"), F.lit(True).alias("brand"))
    rows = tokens.join(fixed, "token", "left").join(brands, "corrected", "left")
    in_order = lambda value, keep: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", value)))), lambda s: s[value])
    known = F.col("corrected").isNotNull()
    return rows.groupBy("qid").agg(
        in_order("corrected", known).alias("words"), in_order("corrected", known & F.col("brand")).alias("required"),
        in_order("token", ~known & F.col("token").isNotNull()).alias("missing"), F.count_if(known & (F.col("corrected") != F.col("token"))).alias("corrections"),
    )


def _answers(classes: DataFrame, queries: DataFrame, known_brands: list[str] | None, found: Index) -> tuple[DataFrame, DataFrame]:
    asked = written(_resolved(queries, found, known_brands))  # a row per query, read by every step below
    usual = written(_matched(classes, asked.where(F.size("words") > 0), found))
    lost = asked.join(usual.select("qid").distinct(), "qid", "left_anti").where((F.size("required") > 0) & (F.size("words") > F.size("required")))
    brand_only = _matched(classes, lost.withColumn("words", F.col("required")), found).withColumn("fallback", F.lit(True))
    return asked, usual.withColumn("fallback", F.lit(False)).union(brand_only)


def search(products: DataFrame, queries: DataFrame, limit: int = 120, known_brands: list[str] | None = None, found: Index | None = None) -> DataFrame:
    """(qid, place, id, tier, score_bp): each query's products; (qid, query) and (id, name, brand, category, merchants).

    Exact names come first, then names holding the phrase, required brands and
    categories; then score, shops, name and id.  Where nothing holds all words,
    the products of the required brands are shown instead.  ``found`` is an
    ``index(...).kept()`` of the products, for several searches over one catalog.
    """
    classes = _classes(products, limit)
    _, rows = _answers(classes, queries, known_brands, found or index(products, known_brands).kept())
    rows = _shown(rows.select("qid", "cls", "tier", "score_bp"), classes, limit, F.desc("tier"), F.desc("score_bp"))
    return rows.select("qid", "place", "id", "tier", "score_bp")


def outcomes(products: DataFrame, queries: DataFrame, known_brands: list[str] | None = None, found: Index | None = None) -> DataFrame:
    """Per query what is to be said: results, brand-miss or empty; the missing words; corrections; results."""
    classes = _classes(products)
    asked, rows = _answers(classes, queries, known_brands, found or index(products, known_brands).kept())
    n = rows.join(classes.select("cls", "n"), "cls").groupBy("qid").agg(F.sum("n").alias("results"), F.bool_or("fallback").alias("fallback"))
    out = asked.join(n, "qid", "left").withColumn("results", F.coalesce("results", F.lit(0)))
    known = F.exists("missing", lambda w: w.isin(known_brands or []))
    instead = F.coalesce("fallback", F.lit(False))
    kind = (
        F.when(F.size("words") == 0, F.when(known, "brand-miss").otherwise("empty")).when(instead | (F.size("missing") > 0), "brand-miss")
        .when(F.col("results") > 0, "results").otherwise("empty")
    )
    missing = F.when(instead, F.concat("missing", F.filter("words", lambda w: ~F.array_contains("required", w)))).otherwise(F.col("missing"))
    return out.select("qid", kind.alias("kind"), F.array_join(missing, " ").alias("missing"), "corrections", "results")


def suggestions(products: DataFrame, prefixes: DataFrame, limit: int = 8) -> DataFrame:
    """(qid, place, id): products (ids are unique) with a word that starts with the prefix (qid, prefix), most shops first.

    A word meets prefixes on each of its beginnings of two to PREFIX letters, so
    only words that begin like the prefix meet it.  Every word does so once;
    products of one name and brand are one row, which takes its words' prefixes.
    """
    classes = _classes(products, limit, ("name", "brand"))
    said = classes.select("cls", F.explode(_hay()).alias("token")).where(F.length("token") >= 2).repartition("token")  # its size is known before it is joined
    beginnings = F.transform(F.sequence(F.lit(2), F.least(F.length("token"), F.lit(PREFIX))), lambda n: F.substr(F.col("token"), F.lit(1), n))
    keyed = said.select("token").distinct().withColumn("k", F.explode(beginnings))
    asked = prefixes.select("qid", F.lower("prefix").alias("prefix")).where(F.length("prefix") >= 2).withColumn("k", F.substring("prefix", 1, PREFIX))
    begun = asked.join(keyed, "k").where(F.startswith("token", F.col("prefix"))).select("qid", "token").distinct()
    rows = begun.join(said, "token").select("qid", "cls").distinct()
    return _shown(rows, classes, limit).select("qid", "place", "id")
