"""Queries of all match rules, name lookup, category paths and payload brands, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom import constants as C
from marketloom.catalog import _query
from marketloom.functions import scalars as S
from marketloom.operators import lookup, matching, paths, payloads
from marketloom.operators.matching import _RULES
from marketloom.sources.bind import Tables
from marketloom.sources.work import spread, written


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _norm(x: str) -> str:
    folded = f"lower(translate(coalesce({x}, ''), '{S.FOLD_FROM}', '{S.FOLD_TO}'))"
    return rf"trim(regexp_replace(regexp_replace({folded}, '([0-9]+)\s*(gb|tb|mb)', '\1\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def _both(values: list[str], a: str, b: str) -> tuple[str, str]:
    return tuple(f"list_filter({side}, lambda w: list_contains({_list(values)}, w))" for side in (a, b))


def _conflict(a: str, b: str) -> str:
    """SQL of the class of which both sides state values and share none."""
    out = "CASE"
    for kind, values in C.VARIANT_CLASSES.items():
        x, y = _both(values + [f"fara-{w}" for w in C.WITHOUT] if kind == "qualifier" else values, a, b)
        if kind == "flavour":
            one = "CASE w " + " ".join(f"WHEN '{form}' THEN '{group[0]}'" for group in C.FLAVOUR_FORMS for form in group[1:]) + " ELSE w END"
            x, y = (f"list_transform({side}, lambda w: {one})" for side in (x, y))
        out += f" WHEN len({x}) > 0 AND len({y}) > 0 AND NOT list_has_any({x}, {y}) THEN '{kind}'"
    return out + " END"


def _except(a: str, b: str) -> str:
    return f"list_filter({a}, lambda w: NOT list_contains({b}, w))"


def _fuzzy(a: str, b: str) -> str:
    alike = "x = y OR (least(len(x), len(y)) >= 3 AND (starts_with(x, y) OR starts_with(y, x))) OR (len(x) = len(y) AND len(x) >= 6 AND levenshtein(x, y) = 1)"
    return f"list_filter({a}, lambda x: NOT coalesce(list_bool_or(list_transform({b}, lambda y: {alike})), false))"


def decide_sql(pairs: str) -> str:
    """SQL that adds reason, band and score_bp to a relation of (catalog, store) pairs, by the thirteen rules."""
    c1, c2, c3, c4 = [], [], [], []
    for s in ("c", "s"):
        c1 += [f"{_norm(f'{s}_name')} AS {s}_norm", f"{_norm(f'{s}_brand')} AS {s}_brandn", f"lower(translate(coalesce({s}_name, ''), '{S.FOLD_FROM}', '{S.FOLD_TO}')) AS {s}_low"]
        c2 += [f"{_words(f'{s}_norm')} AS {s}_tokens", f"{_words(f'{s}_brandn')} AS {s}_brands"]
        stop = _list(C.MATCH_STOP + C.UNIT_NOISE)
        percent = rf"list_transform(regexp_extract_all({s}_name, '([0-9]+(?:[.,][0-9]+)?)\s*%', 1), lambda x: replace(x, ',', '.'))"
        without = f"list_filter(list_transform(range(1, len({s}_tokens)), lambda i: CASE WHEN {s}_tokens[i] = 'fara' AND list_contains({_list(C.WITHOUT)}, {s}_tokens[i + 1]) THEN 'fara-' || {s}_tokens[i + 1] END), lambda x: x IS NOT NULL)"
        doses = rf"list_transform(regexp_extract_all({s}_low, '([0-9]+(?:[.,][0-9]+)?\s*(?:mg|mcg|ui|iu|%)|spf\s*[0-9]+)', 1), lambda x: replace(regexp_replace(x, '\s', '', 'g'), ',', '.'))"
        clothes = rf"list_transform(regexp_extract_all({s}_low, '\bmarim[a-z]*\s+(xxl|xl|xs|s|m|l)\b', 1), lambda x: 'size-' || x)"
        c3 += [
            f"list_distinct(list_filter({s}_tokens, lambda w: NOT list_contains({stop}, w) AND NOT regexp_full_match(w, '[0-9]+(ml|l|kg|g|gr|cl|mg|mcg|ui|iu|buc|x)?'))) AS {s}_over",
            f"list_filter({s}_tokens, lambda t: len(t) >= 3 AND NOT regexp_matches(t, '[0-9]')) AS {s}_sig", f"list_distinct(list_concat({s}_tokens, {percent}, {without})) AS {s}_words",
            f"array_to_string(list_sort(list_distinct(list_concat({doses}, {clothes}))), '|') AS {s}_dose",
            f"list_filter({s}_tokens, lambda t: regexp_full_match(t, '[0-9]{{2,4}}') AND t <> CAST(CAST(trunc({s}_size * 1000) AS BIGINT) AS VARCHAR) AND t <> CAST(CAST(trunc({s}_size) AS BIGINT) AS VARCHAR)) AS {s}_codes",
        ]
        bare = _except(f"{s}_sig", f"{s}_brands")
        c4.append(f"coalesce(({_except(bare, _list(C.VARIANT_MARKERS))})[1], ({bare})[1], {s}_sig[1], '') AS {s}_head")
    described = [w for values in C.DESCRIPTORS.values() for w in values]
    clash = []
    for dimension, values in C.DESCRIPTORS.items():
        if dimension:
            x, y = _both(values, "cl", "sl")
            clash.append(f"(len({x}) > 0 AND len({y}) > 0 AND len({_except(x, y)}) + len({_except(y, x)}) > 0)")
    everywhere, drinks = _list(C.VARIANT_MARKERS), _list(C.VARIANT_MARKERS + C.ALCOHOL_VARIANT_MARKERS)
    marked = [f"CASE WHEN section = 'grocery' THEN list_filter({s}_over, lambda w: list_contains({everywhere}, w)) ELSE list_filter({s}_over, lambda w: list_contains({drinks}, w)) END" for s in ("c", "s")]
    check = "regexp_full_match(c_ean, '[0-9]{8}|[0-9]{12,14}') AND list_sum(list_transform(range(1, len(c_ean) + 1), lambda i: CAST(reverse(c_ean)[i:i] AS INTEGER) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0"
    rules = [
        f"c_ean = s_ean AND {check}", "c_size IS NULL OR s_size IS NULL OR c_unit <> s_unit", f"abs(c_size - s_size) > {C.SIZE_TOLERANCE}::DOUBLE * c_size + 1e-9::DOUBLE",
        "c_head <> '' AND NOT contains(s_norm, c_head)", "c_brandn <> '' AND NOT hit", "kind IS NOT NULL", "c_pack <> s_pack AND greatest(c_pack, s_pack) > 1",
        f"len(cl) > 0 AND len(sl) > 0 AND ({' OR '.join(clash)})", f"len({_except('cl', _list(described))}) > 0 AND len({_except('sl', _list(described))}) > 0",
        f"len({_except(marked[0], marked[1])}) + len({_except(marked[1], marked[0])}) > 0", "c_dose <> '' AND s_dose <> '' AND c_dose <> s_dose",
        "len(c_codes) > 0 AND len(s_codes) > 0 AND NOT list_has_any(c_codes, s_codes)", "len(c_over) >= 2 AND len(s_over) >= 2 AND j < CASE WHEN section = 'grocery' THEN 0.55::DOUBLE ELSE 0.60::DOUBLE END",
    ]
    rule = "CASE " + " ".join(f"WHEN {test} THEN {i}" for i, test in enumerate(rules)) + " ELSE 13 END"
    shared = "greatest(len(c_over) - len(cl), len(s_over) - len(sl))"
    value = "CASE WHEN rule = 0 THEN 1.0::DOUBLE WHEN rule <= 4 THEN 0.0::DOUBLE WHEN rule <= 12 THEN j ELSE score END"
    return f"""SELECT * EXCLUDE (rule, hit, kind, value), CASE WHEN rule = 13 THEN CASE WHEN hit THEN 'brand+size' ELSE 'name+size' END WHEN rule = 5 THEN 'variant-' || kind ELSE ({_list(_RULES)})[rule + 1] END AS reason,
    CASE WHEN rule = 0 OR (rule = 13 AND value >= {C.AUTO_BAND}::DOUBLE) THEN 'AUTO' WHEN rule IN (7, 8, 12, 13) AND value >= {C.REVIEW_BAND}::DOUBLE THEN 'REVIEW' ELSE 'REJECT' END AS band, CAST(floor(value * 10000 + 0.5) AS BIGINT) AS score_bp
  FROM (SELECT *, {value} AS value FROM (SELECT *, least(1.0::DOUBLE, 0.45::DOUBLE + 0.4::DOUBLE * j + 0.15::DOUBLE * CAST(hit AS INTEGER)) AS score FROM (SELECT *, {rule} AS rule FROM
  (SELECT *, CASE WHEN len(c_over) > 0 AND len(s_over) > 0 THEN {shared} / ({shared} + len(cl) + len(sl))::DOUBLE ELSE 0.0::DOUBLE END AS j FROM
  (SELECT *, {_fuzzy("c_over", "s_over")} AS cl, {_fuzzy("s_over", "c_over")} AS sl, {_conflict("c_words", "s_words")} AS kind, c_brandn <> '' AND contains(s_brandn || ' ' || s_norm, c_brandn) AS hit FROM
  (SELECT *, {", ".join(c4)} FROM (SELECT *, {", ".join(c3)} FROM (SELECT *, {", ".join(c2)} FROM (SELECT *, {", ".join(c1)} FROM {pairs})))))))))"""


#: what is added to a product's name on the catalog's and on the store's side, and what else is changed
PLANTED = [
    ("", "", "ean"), ("", "", "unit"), ("", "", "size"), ("", "", "head"), ("", "", "brand"), (" capsuni", " vanilie", ""), (" zero", " light", ""),
    (" fara zahar", " fara gluten", ""), (" 1,5%", " 3,5%", ""), ("", "", "pack"), (" uht", " pasteurizat", ""), (" rubin", " safir", ""), ("", " bio", ""),
    (" 500 mg", " 400 mg", ""), (" cod 123", " cod 456", ""), ("", " de lux pentru toata casa mare", ""), ("", "", ""), ("", "", "nobrand"), (" termometru", " termometri", ""),
    (" portocala", " portocale", ""), (" brut", " rose", ""), (" sticla", " doza", ""), (" pătrat", " patrat", ""), (" marime xl", " marime xs", ""),
]
_VALID_EAN = "4006381333931"


def _planted_pairs(products: DataFrame) -> DataFrame:
    """Every product against a store item made of it, in each of the ways of PLANTED; half of the products are groceries."""
    ways = F.array(*(F.struct(F.lit(i).alias("way"), F.lit(a).alias("ca"), F.lit(b).alias("sa"), F.lit(x).alias("change")) for i, (a, b, x) in enumerate(PLANTED)))
    rows = products.select("id", "name", "brand", "unit", "unit_size", F.inline(ways))
    made = lambda change, other, own: F.when(F.col("change") == change, other).otherwise(own)
    ean = F.when(F.col("change") == "ean", _VALID_EAN)
    return rows.select(
        "id", "way", F.when(F.col("id") % 2 == 0, "grocery").otherwise("alcool").alias("section"), F.concat("name", "ca").alias("c_name"), made("nobrand", F.lit(None), F.col("brand")).alias("c_brand"),
        F.col("unit").alias("c_unit"), F.col("unit_size").alias("c_size"), ean.alias("c_ean"), F.lit(1).alias("c_pack"), made("head", F.lit("altceva"), F.concat("name", "sa")).alias("s_name"),
        made("brand", F.lit("Alta"), F.col("brand")).alias("s_brand"), made("unit", F.lit("pachet"), F.col("unit")).alias("s_unit"), made("size", F.col("unit_size") * 1.5, F.col("unit_size")).alias("s_size"),
        ean.alias("s_ean"), made("pack", F.lit(6), F.lit(1)).alias("s_pack"),
    )


_PLANTED_SQL = ", ways AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}', '{x}')" for i, (a, b, x) in enumerate(PLANTED)) + f""") w(way, ca, sa, change)),
  pairs AS (SELECT id, way, CASE WHEN id % 2 = 0 THEN 'grocery' ELSE 'alcool' END AS section, name || ca AS c_name, CASE WHEN change = 'nobrand' THEN NULL ELSE brand END AS c_brand, unit AS c_unit, unit_size AS c_size,
    CASE WHEN change = 'ean' THEN '{_VALID_EAN}' END AS c_ean, 1 AS c_pack, CASE WHEN change = 'head' THEN 'altceva' ELSE name || sa END AS s_name, CASE WHEN change = 'brand' THEN 'Alta' ELSE brand END AS s_brand,
    CASE WHEN change = 'unit' THEN 'pachet' ELSE unit END AS s_unit, CASE WHEN change = 'size' THEN unit_size * 1.5::DOUBLE ELSE unit_size END AS s_size, CASE WHEN change = 'ean' THEN '{_VALID_EAN}' END AS s_ean,
    CASE WHEN change = 'pack' THEN 6 ELSE 1 END AS s_pack FROM product, ways)"""
def _match_rules(t: Tables) -> DataFrame:
    """The planted pairs decided; products that read alike, and are groceries or not alike, once."""
    rows = t.product.withColumn("half", F.col("id") % 2)
    kinds, mine = matching.alike(rows, "id", ["half", *matching.FACTS], "c_class")
    decided = written(matching.decide(spread(_planted_pairs(kinds), "id", "way")).select(F.col("id").alias("c_class"), "way", "reason", "band", "score_bp"))
    return mine.join(decided, "c_class").select("id", "way", "reason", "band", "score_bp")


_query(
    "match_rules",
    _match_rules,
    _PLANTED_SQL + " SELECT id, way, reason, band, score_bp FROM (" + decide_sql("pairs") + ")",
)


def _name_requests(t: Tables) -> DataFrame:
    """One request per name and brand sold: words turned round, with brand and size; some without brand, with part of a word, or with words no product has."""
    sold = t.product.groupBy("name", "brand").agg(F.min("id").alias("request_id"), F.min_by(F.struct("unit", "unit_size"), "id").alias("p"))
    turned, way = F.array_join(F.reverse(F.split("name", " ")), " "), F.col("request_id") % 6
    asked = (
        F.when(way == 1, turned).when(way == 2, F.concat_ws(" ", F.substring("name", 1, 4), F.get(F.split("name", " "), 1), F.col("brand"))).when(way == 3, "de la 12")
        .when(way == 4, F.concat_ws(" ", "name", F.lit("xyzzy plugh"), "brand")).when(way == 5, F.concat_ws(" ", F.lit("zzqqzz"), "name")).otherwise(F.concat_ws(" ", turned, "brand"))
    )
    return sold.select("request_id", asked.alias("name"), F.when(way != 3, F.concat_ws(" ", F.col("p.unit_size").cast("string"), F.col("p.unit"))).alias("size_text"), "p.unit", "p.unit_size")


_STOP_SQL = _list(C.STOPWORDS)
_query(
    "name_lookup",
    lambda t: lookup.name_lookup(lookup.name_index(t.product), _name_requests(t), t.placed.where("active and not flagged and not is_stale").select(F.col("product_id").alias("id"))),
    f""", sold AS (SELECT name, brand, min(id) AS request_id, arg_min(unit, id) AS unit, arg_min(unit_size, id) AS unit_size FROM product GROUP BY 1, 2),
  requests AS (SELECT request_id, unit, unit_size, CASE request_id % 6 WHEN 1 THEN t WHEN 2 THEN name[1:4] || ' ' || string_split(name, ' ')[2] || ' ' || brand WHEN 3 THEN 'de la 12' WHEN 4 THEN name || ' xyzzy plugh ' || brand
    WHEN 5 THEN 'zzqqzz ' || name ELSE t || ' ' || brand END AS name FROM (SELECT *, array_to_string(list_reverse(string_split(name, ' ')), ' ') AS t FROM sold)),
  asked AS (SELECT *, list_filter({_words(_norm("name"))}, lambda w: len(w) >= 3 AND NOT regexp_matches(w, '[0-9]') AND NOT list_contains({_STOP_SQL}, w))[1:2] AS w FROM requests),
  able AS (SELECT * FROM product WHERE id IN (SELECT product_id FROM placed WHERE active AND NOT flagged AND NOT is_stale)),
  pairs AS (SELECT request_id, p.id, section, p.name AS c_name, p.brand AS c_brand, p.unit AS c_unit, p.unit_size AS c_size, CAST(NULL AS VARCHAR) AS c_ean, 1 AS c_pack, a.name AS s_name, '' AS s_brand, a.unit AS s_unit, a.unit_size AS s_size, CAST(NULL AS VARCHAR) AS s_ean, 1 AS s_pack
    FROM asked a JOIN able p ON len(w) > 0 AND contains({_norm("p.name")}, w[1]) AND contains({_norm("p.name")}, coalesce(w[2], ''))),
  d AS ({decide_sql("pairs")}), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score_bp DESC, id) AS rn FROM d) WHERE rn = 1),
  s AS (SELECT a.request_id, w, b.id, reason, coalesce(score_bp, 0) AS score_bp FROM asked a LEFT JOIN b USING (request_id))
  SELECT request_id, CASE WHEN score_bp >= {round(C.AUTO_BAND * 10000)} THEN 'confident' WHEN score_bp >= {round(C.REVIEW_BAND * 10000)} THEN 'review' ELSE 'none' END AS status,
    CASE WHEN score_bp >= {round(C.AUTO_BAND * 10000)} THEN id END AS product_id, score_bp, CASE WHEN len(w) = 0 THEN 'no-usable-tokens' ELSE coalesce(reason, 'no-candidate') END AS reason FROM s""",
)

_KINDS = ["listed-paths", "url-folders", "breadcrumbs", "stored-path"]


def _stated(t: Tables) -> DataFrame:
    """Offers with the category their merchant states in its own way: cut-off payloads, url folders, breadcrumbs or a stored path, some of them wanting."""
    nation = t.read("nation").select(F.col("n_nationkey").cast("long").alias("category_id"), F.col("n_name").alias("nation"), "n_regionkey")
    region = t.read("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    rows = t.placed.join(nation, "category_id").join(region, "n_regionkey")
    way, word = F.col("merchant_id") % 4, F.get(F.split("name", " "), 1)
    listed = F.format_string('{"productId":"%s","categories":["/%s/%s/%s/","/%s/%s/","/%s/"],"link', "product_id", "region", "nation", word, "region", "nation", "region")
    crumbs = F.format_string('{"breadcrumbs":[{"name":"%s","code":1},{"name":" %s "},{"code":2}]%s', "region", "nation", F.when(F.col("product_id") % 9 == 0, "").otherwise("}"))
    url = F.format_string("https://www.shop.example/%s/%s/%s/p/%s?x=1", F.replace("region", F.lit(" "), F.lit("-")), "nation", F.replace("name", F.lit(" "), F.lit("-")), "product_id")
    stored = F.when(F.col("product_id") % 10 == 0, F.col("region")).when(F.col("product_id") % 7 != 0, F.concat(F.replace("region", F.lit(" "), F.lit("_")), F.lit(" / "), "nation"))
    return rows.select(
        "product_id", "merchant_id", "region", "nation", F.when(way == 0, listed).when(way == 2, crumbs).alias("payload"), F.when(way == 1, url).alias("url"), F.when(way == 3, stored).alias("category_path"),
    )


def _path_kinds(t: Tables) -> DataFrame:
    return t.merchant.select("merchant_id", F.get(F.array(*(F.lit(k) for k in _KINDS[:3])), (F.col("merchant_id") % 4).cast("int")).alias("kind")).where("kind is not null")


def _own_tree(t: Tables) -> DataFrame:
    """The paths of the own tree that have a leaf: all regions and nations but those of Europe."""
    rows = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(F.array("r_name", "n_name").alias("levels"), F.when(F.col("r_name") != "EUROPE", F.lower("n_name")).alias("leaf"), S.slug(F.col("r_name")).alias("department"))


_STATED = """, st AS (SELECT product_id, merchant_id, r_name AS region, n_name AS nation, string_split(name, ' ')[2] AS word, merchant_id % 4 AS way FROM placed JOIN nation ON n_nationkey = category_id JOIN region ON r_regionkey = n_regionkey),
  rec AS (SELECT *, CASE way WHEN 0 THEN [region, nation, word] WHEN 1 THEN [region, nation] WHEN 2 THEN CASE WHEN product_id % 9 <> 0 THEN [region, nation] END ELSE CASE WHEN product_id % 10 = 0 THEN [region] WHEN product_id % 7 <> 0 THEN [replace(region, '_', ' '), replace(nation, '_', ' ')] END END AS levels FROM st),
  keyed AS (SELECT *, array_to_string(list_transform(levels, lambda x: replace(lower(x), '_', ' ')), ' / ') AS path FROM rec)"""
_query(
    "path_recovery",
    lambda t: paths.recovered(_stated(t), _path_kinds(t)).select("product_id", "merchant_id", paths.path_key(F.col("levels")).alias("path"), F.coalesce(F.size("levels"), F.lit(0)).alias("depth"), "path_source"),
    _STATED + f" SELECT product_id, merchant_id, path, CAST(coalesce(len(levels), 0) AS INTEGER) AS depth, CASE WHEN levels IS NOT NULL THEN ({_list(_KINDS)})[way + 1] END AS path_source FROM keyed",
)
_query(
    "path_leaves",
    lambda t: paths.by_longest_prefix(paths.recovered(_stated(t), _path_kinds(t)), paths.path_trie(_own_tree(t))).withColumn("path", paths.path_key(F.col("levels"))).groupBy("path", "leaf", "department", "depth", "band").agg(F.count(F.lit(1)).alias("spellings")),
    _STATED + """, distinct_ AS (SELECT DISTINCT levels, path FROM keyed WHERE levels IS NOT NULL)
  SELECT path, CASE WHEN len(levels) > 1 AND levels[1] <> 'EUROPE' THEN replace(lower(levels[2]), ' ', '_') END AS leaf, replace(lower(levels[1]), ' ', '-') AS department, CAST(least(len(levels), 2) AS INTEGER) AS depth,
    CASE WHEN len(levels) > 1 AND levels[1] <> 'EUROPE' THEN 'AUTO' ELSE 'REVIEW' END AS band, count(*) AS spellings FROM distinct_ GROUP BY ALL""",
)


def _tree_rules(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Name rules, one word per nation's number, and the departments with their labels."""
    rows = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nothing = F.lit(None).cast("string")
    rules = rows.select(F.lower("n_name").alias("category"), S.slug(F.col("r_name")).alias("department"), F.col("n_nationkey").cast("string").alias("word"), nothing.alias("phrase"), nothing.alias("avoid"))
    return rules, t.read("region").select(S.slug(F.col("r_name")).alias("department"), F.concat(F.lit("Produse "), "r_name").alias("label"), F.col("r_regionkey").alias("place"))


_query(
    "path_names",
    lambda t: paths.assign_by_path(paths.recovered(_stated(t), _path_kinds(t)), *_tree_rules(t)).withColumn("path", paths.path_key(F.col("levels"))).groupBy("path", "leaf", "department", "score", "band", "reason").agg(F.count(F.lit(1)).alias("spellings")),
    # a nation's number is the second word of its level: 90
    _STATED + """, d AS (SELECT DISTINCT levels, path FROM keyed WHERE levels IS NOT NULL)
  SELECT path, CASE WHEN len(levels) > 1 THEN replace(lower(levels[2]), ' ', '_') ELSE replace(lower(levels[1]), ' ', '-') || '-altele' END AS leaf, replace(lower(levels[1]), ' ', '-') AS department,
    CASE WHEN len(levels) > 1 THEN 90 ELSE 62 END AS score, 'AUTO' AS band, CASE WHEN len(levels) > 1 THEN 'level ' || levels[2] ELSE 'department' END AS reason, count(*) AS spellings FROM d GROUP BY ALL""",
)


def _brand_payloads(t: Tables) -> DataFrame:
    """A payload per product that states its brand at one of six depths, behind stand-ins, or not at all; every ninth is cut off."""
    named = F.concat(F.lit('"'), "brand", F.lit('"'))
    shapes = [
        F.concat(F.lit('{"z":{"brand":"Inner"},"brand":'), named, F.lit("}")), F.concat(F.lit('{"brand":"(bucata)","manufacturer":{"name":'), named, F.lit("}}")),
        F.concat(F.lit('{"items":[{"x":1},{"seller":{"marca":'), named, F.lit('}}],"a":{"brandName":"Later"}}')), F.concat(F.lit('{"a":{"b":{"c":{"d":{"brand":'), named, F.lit("}}}}}")),
        F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":{"brand":'), named, F.lit("}}}}}}")), F.lit('{"brand":7,"items":[1,2],"producator":"NO BRAND"}'),
    ]
    shape = F.get(F.array(*shapes), (F.col("id") % 6).cast("int"))
    return t.product.select("id", F.when(F.col("id") % 9 == 0, F.substring(shape, 1, 30)).otherwise(shape).alias("payload"))


_query(
    "payload_brands",
    lambda t: payloads.payload_brands(_brand_payloads(t)),
    """SELECT id, brand AS value, ['brand', 'manufacturer.name', 'marca', 'brand'][id % 6 + 1] AS key, CAST([0, 0, 3, 4][id % 6 + 1] AS INTEGER) AS depth FROM product WHERE id % 9 <> 0 AND id % 6 < 4""",
)
