"""Paged endpoints as a Spark source: a partition for each part (a country, or a sensor and window), read page by page.

    spark.dataSource.register(PagedSource)
    rows = spark.read.format("paged").option("base", url_or_folder).option("parts", parts_json([...])).load()

A short page ends a part; a count that the service claims is not trusted. A page that fails keeps those before it and marks the
part `partial`; a part whose first page fails is `failed`, and the other parts are not touched by either. Each part ends with
one row without a record that has its status: records() and outcomes() take the two kinds apart.

`base` is an http(s) address (?page= and ?limit= are added), or a folder that workers can open, with pages under
<part's path>/page=<number>/, or many together under <part's path>/book=<number>/, as store() writes them: a line for each page.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "part string, page int, position long, record string, status string, detail string"
#: Attempts, and the least and most seconds between them.
TRIES, WAIT_LEAST, WAIT_MOST = 4, 2.0, 30.0
#: The only time filters that the service honours; it ignores others without a word.
TIME_FILTERS = ("datetime_from", "datetime_to")
MOST_PAGES = 1000
BOOK = 100  # pages that are stored together, and read together


class PageError(Exception):
    """A page that trying again won't mend."""


@dataclass
class Part(InputPartition):
    name: str
    path: str
    params: dict[str, str]
    max_pages: int = MOST_PAGES


def locations(country: str) -> dict:
    """The part of one country's locations."""
    return {"name": country, "path": "locations", "params": {"iso": country}}


def sensor_hours(sensor: object, begin: str, end: str, n_hours: int, limit: int) -> dict:
    """The part of one sensor's hours in a window. It needs at most so many pages as its hours fill, and one to spare."""
    return {"name": f"{sensor}:{begin}", "path": f"sensors/{sensor}/hours", "params": dict(zip(TIME_FILTERS, (begin, end), strict=True)), "max_pages": max(1, -(-n_hours // limit) + 1)}


def parts_json(parts: list[dict]) -> str:
    for p in parts:
        unknown = [k for k in p.get("params", {}) if "date" in k and k not in TIME_FILTERS]
        if unknown:
            raise ValueError(f"time filters are {TIME_FILTERS}; {unknown} would be ignored")
    return json.dumps(parts)


def fetch_http(base: str, path: str, params: dict[str, str], headers: dict[str, str], pause: Callable[[float], None] = time.sleep, scale: float = 1.0) -> dict:
    """A page's payload. Connection errors, 429 and 5xx are tried again; any other 4xx is final."""
    url = f"{base.rstrip('/')}/{path.lstrip('/')}?{urllib.parse.urlencode(params)}"
    for k in range(TRIES):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"Accept": "application/json", **headers}), timeout=30) as got:
                return json.loads(got.read())
        except urllib.error.HTTPError as e:
            if 400 <= e.code < 500 and e.code != 429:
                raise PageError("401: check the key" if e.code == 401 else f"{e.code} from {path}") from None
            last = f"{e.code} from {path}"
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            last = str(e)
        if k + 1 < TRIES:
            pause(scale * min(max(2.0**k, WAIT_LEAST), WAIT_MOST))
    raise PageError(f"{last}, {TRIES} times")


def _texts(base: str, path: str) -> list[bytes]:
    """The contents of a folder's files; none if it isn't there."""
    from pyarrow import fs

    where = f"{base.rstrip('/')}/{path}"
    store, folder = fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [store.open_input_stream(f.path).read() for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith((".", "_"))]


def fetch_stored(base: str, path: str, params: dict[str, str], held: dict | None = None) -> dict:
    """A page's payload, from its book or its own folder. held keeps the last book that was read, for the pages after."""
    held, number = {} if held is None else held, int(params["page"])
    key = (base, path, (number - 1) // BOOK)
    if held.get("key") != key:
        lines = b"\n".join(_texts(base, f"{path}/book={key[2]}")).splitlines()
        held["key"], held["pages"] = key, {p["page"]: p.get("value", "") for p in map(json.loads, filter(None, lines))}
    if number in held["pages"]:
        return json.loads(held["pages"][number])
    texts = _texts(base, f"{path}/page={number}")
    if not texts:
        raise PageError(f"page {params['page']} isn't there")
    return json.loads(b"".join(texts))


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(dict(self.options))


class PagedReader(DataSourceReader):
    """Options: base, parts (JSON), limit (records of a page), key (sent as X-API-Key), waitscale (of the pauses)."""

    def __init__(self, options: dict[str, str]):
        self.base, self.parts = options["base"], json.loads(options["parts"])
        self.held: dict = {}
        self.limit, self.key, self.scale = int(options.get("limit", "1000")), options.get("key"), float(options.get("waitscale", "1"))

    def partitions(self) -> list[InputPartition]:
        return [Part(p["name"], p["path"], p.get("params", {}), p.get("max_pages", MOST_PAGES)) for p in self.parts]

    def page(self, part: Part, number: int) -> list[dict]:
        if self.base.startswith(("http://", "https://")):
            params = {**part.params, "limit": str(self.limit), "page": str(number)}
            payload = fetch_http(self.base, part.path, params, {"X-API-Key": self.key} if self.key else {}, scale=self.scale)
        else:
            payload = fetch_stored(self.base, part.path, {"page": str(number)}, self.held)
        results = payload.get("results") if isinstance(payload, dict) else None
        if results is not None and not isinstance(results, list):
            raise PageError("results is no list")
        return results or []

    def read(self, part: Part) -> Iterator[tuple]:
        position, status, detail, number = 0, "complete", None, 0
        while True:
            number += 1
            if number > part.max_pages:
                status, detail = "partial", f"more than {part.max_pages} pages"
                break
            try:
                results = self.page(part, number)
            except (PageError, ValueError, OSError) as e:
                status, detail = ("partial" if number > 1 else "failed"), f"page {number}: {e}"[:300]
                break
            for r in results:
                yield part.name, number, position, json.dumps(r, ensure_ascii=False), None, None
                position += 1
            if len(results) < self.limit:
                break
        yield part.name, number, position, None, status, detail


def records(rows: DataFrame, schema: str) -> DataFrame:
    """(part, position, r): the records as structs of a schema."""
    return rows.where("record is not null").select("part", "position", F.from_json("record", schema).alias("r"))


def outcomes(rows: DataFrame) -> DataFrame:
    """(part, n_records, status, detail): how each part ended."""
    return rows.where("status is not null").select("part", F.col("position").alias("n_records"), "status", "detail")


def paged(rows: DataFrame, part_path: Column, order: str, record: Column, limit: int) -> DataFrame:
    """(path, page, value): rows as pages of `limit` records, by their order in a part; a part that fills its last page has an empty one after it."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("path").orderBy("_order")) - 1
    flat = rows.select(part_path.alias("path"), F.col(order).alias("_order"), record.alias("_r")).withColumn("page", F.floor(at / limit).cast("int") + 1)
    pages = flat.groupBy("path", "page").agg(F.array_sort(F.collect_list(F.struct("_order", "_r"))).alias("_rs"))  # at most limit records
    text = F.to_json(F.struct(F.transform("_rs", lambda x: x["_r"]).alias("results")))
    ends = flat.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") % limit == 0).select("path", (F.col("n") / limit + 1).cast("int").alias("page"), F.lit('{"results": []}').alias("value"))
    return pages.select("path", "page", text.alias("value")).unionByName(ends)


def store(pages: DataFrame, base: str) -> None:
    """Write pages (path, page, value) so that the source finds them: a folder for each path and book of pages, so that files are few."""
    books = pages.select(F.col("path").alias("part"), F.floor((F.col("page") - 1) / BOOK).alias("book"), F.to_json(F.struct("page", "value")).alias("line"))
    books.repartition("part", "book").write.partitionBy("part", "book").text(base)
