"""Sources and sinks: JSON payloads, HTML cards, page templates, upserts, CSV, snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.scalars import parse_decimal


def json_products(raw: DataFrame, items_path: str, fields: dict[str, str], column: str = "payload") -> DataFrame:
    """One row per item of the JSON payloads: ``fields`` maps column names to dotted paths in an item.

    Items may be an array or an object, whose values are then the items.
    Payloads that do not parse have no items.
    """
    doc = F.try_parse_json(F.col(column))
    items = F.try_variant_get(doc, f"$.{items_path}", "array<variant>")
    by_key = F.map_values(F.try_variant_get(doc, f"$.{items_path}", "map<string,variant>"))
    rows = raw.select("*", F.explode(F.coalesce(items, by_key)).alias("_item"))
    return rows.select(*raw.columns, *(F.try_variant_get("_item", f"$.{path}", "string").alias(name) for name, path in fields.items())).drop(column)


class _Cards(HTMLParser):
    """Collects text by class name inside elements of the card class."""

    def __init__(self, card: str, wanted: dict[str, str]) -> None:
        super().__init__()
        self.card, self.wanted, self.rows, self.stack = card, wanted, [], []
        self.depth: int | None = None

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        classes = (dict(attrs).get("class") or "").split()
        self.stack.append([c for c, k in self.wanted.items() if k in classes])
        if self.card in classes and self.depth is None:
            self.depth = len(self.stack)
            self.rows.append(dict.fromkeys(self.wanted, ""))

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if self.depth is not None and len(self.stack) == self.depth:
            self.depth = None
        if self.stack:
            self.stack.pop()

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if self.depth is not None and self.rows:
            for names in self.stack:
                for c in names:
                    self.rows[-1][c] += data


def html_cards(pages: DataFrame, card: str, fields: dict[str, str], html_col: str = "html") -> DataFrame:
    """One row per product card of the stored HTML; ``fields`` maps column names to class names."""
    kept = [c for c in pages.columns if c != html_col]

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            owner, found = [], []
            for i, html in enumerate(batch.column(html_col).to_pylist()):
                rows = cards_of(html, card, fields)
                owner += [i] * len(rows)
                found += rows
            columns = [batch.column(c).take(pa.array(owner, pa.int64())) for c in kept]
            columns += [pa.array([r[f] for r in found], pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *fields])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` string" for c in fields)])
    return pages.mapInArrow(run, schema)


def cards_of(html: str | None, card: str, fields: dict[str, str]) -> list[dict[str, str | None]]:
    """The product cards of a page: text by field, null where empty."""
    parser = _Cards(card, fields)
    parser.feed(html or "")
    return [{k: v.strip() or None for k, v in r.items()} for r in parser.rows]


def register(spark: SparkSession) -> None:
    """Makes SQL names of what needs Python: parse_price, parse_quantity, osa_distance, and the table function explode_cards(html, card, name, price)."""
    from marketloom.functions import prices

    @F.pandas_udf("bani long, reference_bani long, reference_kind string")
    def parse_price(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([prices.read_price(x) for x in texts], columns=["bani", "reference_bani", "reference_kind"])
        return out.astype({"bani": "Int64", "reference_bani": "Int64"})

    @F.pandas_udf("value double, unit string, pack_count int")
    def parse_quantity(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([prices.read_quantity(x) for x in texts], columns=["value", "unit", "pack_count"]).astype({"pack_count": "Int64"})

    @F.pandas_udf("int")
    def osa_distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([prices.osa(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="Int64")

    class ExplodeCards:
        def eval(self, html: str, card: str, name: str, price: str):  # noqa: ANN202
            for r in cards_of(html, card, {"name": name, "price": price}):
                yield r["name"], r["price"]

    for function in (parse_price, parse_quantity, osa_distance):
        spark.udf.register(function.__name__, function)
    spark.udtf.register("explode_cards", F.udtf(ExplodeCards, returnType="name string, price string"))


@dataclass(frozen=True)
class Adapter:
    """How a source's landed payloads become products: JSON items by dotted paths, or HTML cards by class names.

    ``refine`` may change the rows; rows without a name are dropped, and an item
    counts once per ``url|name``.
    """

    mode: str
    fields: dict[str, str]
    items: str = ""
    card: str = ""
    template: str = ""
    max_pages: int = 1
    page_size: int = 0
    refine: Callable[[DataFrame], DataFrame] | None = None

    def routes(self, spark: SparkSession) -> DataFrame:
        """The addresses to fetch."""
        return page_urls(spark, self.template, self.max_pages, self.page_size)

    def products(self, landed: DataFrame) -> DataFrame:
        """Product rows of landed pages (payload or html)."""
        if self.mode not in ("json", "dom"):
            raise ValueError("mode is json or dom")
        rows = json_products(landed, self.items, self.fields) if self.mode == "json" else html_cards(landed, self.card, self.fields)
        if self.refine is not None:
            rows = self.refine(rows)
        rows = rows.where(F.coalesce(F.trim("name"), F.lit("")) != "")
        return rows.dropDuplicates([c for c in ("url", "name") if c in rows.columns])


def write_audit(findings: DataFrame, path: str) -> int:
    """An audit's findings as JSON lines under their count; returns the count."""
    n = findings.count()
    findings.withColumn("findings", F.lit(n)).write.mode("overwrite").json(path)
    return n


def split_price(parts: Column) -> Column:
    """struct<price,reference> of array<struct<parts:array<string>,struck:boolean>>: last unstruck, first struck."""
    text = lambda g: F.when(F.forall(g["parts"], lambda p: p.rlike("^[0-9]{1,5}$")), F.array_join(g["parts"], ","))
    fine = F.filter(parts, lambda g: (F.size(g["parts"]) == 2) & F.get(g["parts"], F.lit(1)).rlike("^[0-9]{2}$"))
    open_, struck = F.filter(fine, lambda g: ~g["struck"]), F.filter(fine, lambda g: g["struck"])
    return F.struct(
        parse_decimal(text(F.try_element_at(open_, F.lit(-1)))).alias("price"), parse_decimal(text(F.try_element_at(struck, F.lit(1)))).alias("reference")
    )


def page_urls(spark: SparkSession, template: str, pages: int, size: int = 0) -> DataFrame:
    """The addresses of a paged route: {page} from 1, {from} and {to} as 0-based row numbers."""
    n = F.col("id") + 1
    url = F.replace(F.lit(template), F.lit("{page}"), n.cast("string"))
    url = F.replace(url, F.lit("{from}"), (F.col("id") * size).cast("string"))
    return spark.range(pages).select(n.alias("page"), F.replace(url, F.lit("{to}"), (n * size - 1).cast("string")).alias("url"))


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Share of rows with a non-empty value, per field, in basis points."""
    filled = [F.floor(F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) != "") * 10000 / F.count(F.lit(1)) + 0.5).cast("long").alias(f) for f in fields]
    one = rows.agg(*filled)
    return one.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("filled_bp")) for f in fields))))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` (unique by ``keys``) replacing or joining its own."""
    return table.join(changes, keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def append_on_change(last: DataFrame, fresh: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of ``fresh`` whose value is new or differs from the last one known."""
    known = last.select(*keys, F.col(value).alias("_last"))
    return fresh.join(known, keys, "left").where(F.col("_last").isNull() | (F.col("_last") != F.col(value))).drop("_last")


def write_csv(rows: DataFrame, path: str) -> int:
    """CSV with a header and doubled quotes; returns the rows read back."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.sparkSession.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).count()


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines."""
    rows.write.mode("append").json(path)


def snapshot(rows: DataFrame, path: str, money: str) -> bool:
    """Writes a Parquet copy; tells whether count and sum of ``money`` agree with the source."""
    rows.write.mode("overwrite").parquet(path)
    facts = lambda df: df.agg(F.count(F.lit(1)), F.sum(money)).first()
    return facts(rows) == facts(rows.sparkSession.read.parquet(path))
