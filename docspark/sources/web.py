"""Fetching: a Python data source with one partition per host, header rules, renderers and retries."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[str], tuple[str, str]]


def request_headers(user_agent: str, headers: dict[str, str] | None = None) -> dict[str, str]:
    """The given headers, and the user agent unless they name one."""
    merged = dict(headers or {})
    if not any(k.lower() == "user-agent" for k in merged):
        merged["User-Agent"] = user_agent
    return merged


def fetch_url(url: str, *, timeout: int = 30, user_agent: str = "docspark/0.1", headers: dict[str, str] | None = None, opener=urllib.request.urlopen) -> tuple[str, str]:
    """``(text, content type)``; the stated charset else UTF-8, wrong bytes replaced."""
    request = urllib.request.Request(url, headers=request_headers(user_agent, headers))
    with opener(request, timeout=timeout) as response:
        charset = response.headers.get_content_charset() or "utf-8"
        return response.read().decode(charset, errors="replace"), response.headers.get("content-type", "")


def renderer(name: str, static: Fetch, browser: Fetch | None = None) -> Fetch:
    """``static``, ``playwright``/``browser``, or ``auto`` (the browser, and on any error the static way)."""
    name = (name or "static").lower()
    if name == "static":
        return static
    if name in ("playwright", "browser", "auto"):
        def by_browser(url: str) -> tuple[str, str]:
            if browser is None:
                raise RuntimeError("no browser is available for rendering")
            return browser(url)

        if name != "auto":
            return by_browser

        def either(url: str) -> tuple[str, str]:
            try:
                return by_browser(url)
            except Exception:
                return static(url)

        return either
    raise ValueError(f"unknown renderer: {name}")


class _Host(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        super().__init__(0)
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.delay = float(options.get("request_delay_seconds", 0) or 0)
        self.timeout = int(options.get("timeout_seconds", 30) or 30)
        self.agent = options.get("user_agent", "docspark/0.1")
        self.headers = json.loads(options.get("headers", "") or "{}")
        self.renderer = options.get("renderer", "static")

    def partitions(self) -> list[InputPartition]:
        hosts: dict[str, list[str]] = {}
        for u in dict.fromkeys(self.urls):
            hosts.setdefault(urlsplit(u).netloc, []).append(u)
        return [_Host(x) for x in hosts.values()] or [_Host([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        static = lambda url: fetch_url(url, timeout=self.timeout, user_agent=self.agent, headers=self.headers)
        fetch = renderer(self.renderer, static)
        for url in partition.urls:
            try:
                text, kind = fetch(url)
                yield url, text, kind, None
            except Exception as error:  # a failed page is a row, not a failed job
                yield url, None, None, f"{type(error).__name__}: {error}"
            time.sleep(max(0.0, self.delay))


class WebFetch(DataSource):
    """``spark.dataSource.register(WebFetch)``; ``format("web_fetch").option("urls", "a\\nb")``: ``url, raw_text, content_type, error``."""

    @classmethod
    def name(cls) -> str:
        return "web_fetch"

    def schema(self) -> str:
        return "url string, raw_text string, content_type string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
