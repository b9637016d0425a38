"""A paginated REST source as a Spark data source."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class _NoRedirect(HTTPRedirectHandler):
    def redirect_request(self, *args):
        raise ValueError(f"the server redirects to {args[-1]}; redirects are refused")


def check_url(url: str, origin: str | None = None) -> str:
    """An http(s) URL, of the same origin if one is given; anything else is refused."""
    u = urlsplit(url)
    if u.scheme not in ("http", "https") or not u.hostname:
        raise ValueError(f"{url} is no http(s) URL")
    if origin is not None and (u.scheme, u.netloc) != urlsplit(origin)[:2]:
        raise ValueError(f"{url} is of another origin than {origin}")
    return url


def fetch(url: str, token: str | None = None, timeout: float = 30.0) -> dict:
    request = Request(url, headers={"Accept": "application/json"} | ({"Authorization": "Bearer " + token} if token else {}))
    with build_opener(_NoRedirect).open(request, timeout=timeout) as r:
        return json.load(r)


def pages(url: str, token: str | None = None, limit: int | None = None, updated_after: str | None = None, get: Callable[..., dict] = fetch) -> Iterator[list[dict]]:
    """The records of each page. ``limit`` and ``updated_after`` go with the first request only; ``next`` must keep the origin."""
    extra = {k: v for k, v in (("limit", limit), ("updated_after", updated_after)) if v is not None}
    at: str | None = check_url(url) + (("&" if "?" in url else "?") + urlencode(extra) if extra else "")
    while at:
        body = get(at, token)
        yield body.get("data") or []
        at = check_url(urljoin(url, body["next"]), url) if body.get("next") else None


class RestSource(DataSource):
    """spark.read.format("orbweaver_rest").schema(...).option("url", ...).load(); options url, token, limit, updated_after."""

    @classmethod
    def name(cls) -> str:
        return "orbweaver_rest"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.options = schema, options
        check_url(options["url"])

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # pages follow each other

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        o = self.options
        for rows in pages(o["url"], o.get("token"), o.get("limit"), o.get("updated_after")):
            for r in rows:
                yield tuple(r.get(f.name) for f in self.schema)
