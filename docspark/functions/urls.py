"""Predicates and parts of URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def authority(url: Column) -> Column:
    """Host with port and user, as written; null for anything without one."""
    part = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.when(part != "", part)


def url_allowed(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Some include pattern is found (or there is none), and no exclude pattern is."""
    anyof = lambda patterns: reduce(lambda a, b: a | b, [url.rlike(p) for p in patterns])
    ok = anyof(include) if include else F.lit(True)
    return ok & ~anyof(exclude) if exclude else ok


def same_domain(url: Column, starts: list[str]) -> Column:
    hosts = {s.split("://", 1)[1].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0] for s in starts if "://" in s}
    return F.coalesce(authority(url).isin(sorted(hosts)), F.lit(False))


def resolved_path(path: Column) -> Column:
    """A path without empty parts and ``.``; ``..`` takes back the part before it."""
    kept = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(kept, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(walked, "/"))


def relative_path(path: Column, base: str) -> Column:
    """The path from ``base`` on if it lies under it, else the whole path, both resolved."""
    whole, root = resolved_path(path), resolved_path(F.lit(base))
    below = F.when(root == "/", whole.startswith("/")).otherwise(whole.startswith(F.concat(root, F.lit("/"))))
    return F.when(whole == root, ".").when(below, F.regexp_replace(F.substr(whole, F.length(root) + 1), "^/", "")).otherwise(whole)
