"""Paged routes of a shop as a Spark data source: a partition per route, in batch and as a stream.

The class that ``paged_source`` makes is registered with
``spark.dataSource.register`` and then read like any format.  A route's pages are
read in order until one adds no product (or is missing), at most ``max_pages``.
The stream's offset is the number of the last page that is there, of each route; a
restarted stream goes on from the pages that its checkpoint names.  A product counts once per
``url|name``: within a route in the reader, across routes by ``products``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from marketloom.sources.readers import cards_of


@dataclass(frozen=True)
class Route:
    """An address with {page}, {from} or {to} (or none: one page), and the category it lists."""

    url: str
    category: str = ""

    def page(self, n: int, size: int) -> str | None:
        """The address of page n, counted from 1; null where there can be none."""
        if n > 1 and not any(mark in self.url for mark in ("{page}", "{from}", "{to}")):
            return None
        first = (n - 1) * size
        return self.url.replace("{page}", str(n)).replace("{from}", str(first)).replace("{to}", str(first + size - 1))


@dataclass(frozen=True)
class Shop:
    """How a shop's pages become products: JSON items by dotted paths, or HTML cards by class names.

    ``fetch`` gives the text at an address, or null; it runs in the executors
    (and, for the stream's offset, on the driver).
    """

    routes: list[Route]
    fields: dict[str, str]
    fetch: Callable[[str], str | None]
    items: str = ""
    card: str = ""
    max_pages: int = 1
    page_size: int = 0

    def products(self, text: str) -> list[dict[str, str | None]]:
        """The products of one page, those without a name left out; a text that is no JSON has none."""
        rows = cards_of(text, self.card, self.fields) if self.card else list(self._json(text))
        return [r for r in rows if (r.get("name") or "").strip()]

    def _json(self, text: str) -> Iterator[dict[str, str | None]]:
        try:
            found = _at(json.loads(text), self.items)
        except json.JSONDecodeError:
            return
        for item in found.values() if isinstance(found, dict) else found if isinstance(found, list) else []:
            values = {name: _at(item, path) for name, path in self.fields.items()}
            yield {k: None if v is None else v if isinstance(v, str) else json.dumps(v) for k, v in values.items()}

    def read(self, route: int, after: int, upto: int) -> Iterator[tuple]:
        """Rows (route, category, page, place, fields...) of a route's pages after ``after``, up to ``upto``.

        Earlier pages are read again to know what the route already gave, so that
        a reader without a memory ends where one that read all pages would.
        """
        own, seen = self.routes[route], set()
        for n in range(1, min(upto, self.max_pages) + 1):
            url = own.page(n, self.page_size)
            text = self.fetch(url) if url is not None else None
            if text is None:
                return
            fresh = []
            for place, row in enumerate(self.products(text)):
                key = f"{row.get('url')}|{row['name']}"
                if key not in seen:
                    seen.add(key)
                    fresh.append((route, own.category, n, place, *(row[f] for f in self.fields)))
            if not fresh:
                return
            if n > after:
                yield from fresh

    def last_page(self, route: int, known: int) -> int:
        """The last page of a route that is there, ``known`` or more."""
        while known < self.max_pages:
            url = self.routes[route].page(known + 1, self.page_size)
            if url is None or self.fetch(url) is None:
                break
            known += 1
        return known


def _at(value: object, path: str) -> object:
    for part in path.split(".") if path else []:
        value = value.get(part) if isinstance(value, dict) else value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else None
    return value


class _Pages(InputPartition):
    def __init__(self, route: int, after: int, upto: int) -> None:
        super().__init__((route, after, upto))
        self.route, self.after, self.upto = route, after, upto


class _Batch(DataSourceReader):
    def __init__(self, shop: Shop) -> None:
        self.shop = shop

    def partitions(self) -> list[_Pages]:
        return [_Pages(i, 0, self.shop.max_pages) for i in range(len(self.shop.routes))]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return self.shop.read(partition.route, partition.after, partition.upto)


class _Stream(DataSourceStreamReader):
    def __init__(self, shop: Shop) -> None:
        self.shop, self.pages = shop, [0] * len(shop.routes)

    def initialOffset(self) -> dict:
        return {"pages": [0] * len(self.shop.routes)}

    def latestOffset(self) -> dict:
        self.pages = [self.shop.last_page(i, known) for i, known in enumerate(self.pages)]
        return {"pages": self.pages}

    def partitions(self, start: dict, end: dict) -> list[_Pages]:
        spans = zip(start["pages"], end["pages"], strict=True)
        return [_Pages(i, after, upto) for i, (after, upto) in enumerate(spans) if upto > after]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        return self.shop.read(partition.route, partition.after, partition.upto)

    def commit(self, end: dict) -> None:
        pass


def paged_source(name: str, shop: Shop) -> type[DataSource]:
    """A data source of that name: route int, category, page int, place int, and the shop's fields as strings."""

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return "route int, category string, page int, place int, " + ", ".join(f"`{f}` string" for f in shop.fields)

        def reader(self, schema: object) -> DataSourceReader:
            return _Batch(shop)

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return _Stream(shop)

    label = name
    return Paged


def products(pages: DataFrame) -> DataFrame:
    """One row per ``url|name``, in batch and as a stream (whose memory grows with the products of the crawl)."""
    return pages.dropDuplicates([c for c in ("url", "name") if c in pages.columns])
