"""Files as tables: saved pages, lists of URLs, labels and settings."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types


def html_dir(spark: SparkSession, path: str) -> DataFrame:
    """``file, html`` of the .html and .htm files of a folder, read whole; bytes that are no UTF-8 go.
    Fewer than two files are an error, as there is nothing to compare."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{html,htm}").load(path)
    pages = raw.select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), _utf8(F.col("content")).alias("html"))
    if len(pages.select("file").take(2)) < 2:
        raise ValueError(f"{path} holds fewer than two pages")
    return pages


@F.pandas_udf(types.StringType())
def _utf8(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """``url``: the lines of a text file but empty ones and those that begin with #."""
    line = F.trim(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.read.text(path).select(line.alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def with_scheme(url: Column, scheme: str = "https") -> Column:
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), url).otherwise(F.concat(F.lit(scheme + "://"), url))


def labels(spark: SparkSession, text: str) -> DataFrame:
    """``class_id, name, kind, typical``: the classes of a TOML text, numbered in order."""
    rows = []
    for i, c in enumerate(tomllib.loads(text).get("classes", [])):
        if c.get("kind", "known") not in ("malicious", "benign", "known"):
            raise ValueError(f"class {c['name']}: no such kind: {c['kind']}")
        rows.append((i, c["name"], c.get("kind", "known"), list(c.get("typical_domains", []))))
    return spark.createDataFrame(rows, "class_id int, name string, kind string, typical array<string>")


@dataclass
class Settings:
    """What the operators take as parameters, with the defaults of a settings file that has the section."""

    watch_threshold: int = 30
    probe_threshold: int = 60
    cache_days: int = 7
    length_dim: int = 10
    select_dir: int = 1
    flow_timeout_s: float = 30.0
    conf_threshold: float = 0.5
    skip_private: bool = True
    ip_cooldown_s: int = 60
    skip_ports: list[int] = field(default_factory=lambda: [22, 23, 25, 53, 110, 123, 143, 389, 3478, 5353])
    skip_ips: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=lambda: ["passive-dns", "ptr", "hackertarget"])
    skip_domain_suffixes: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, *texts: str | None) -> "Settings":
        """The first text that is valid TOML counts, others are passed over; without one, the defaults.
        Sections only group keys; unknown keys are left out."""
        for text in texts:
            try:
                data = tomllib.loads(text) if text is not None else None
            except tomllib.TOMLDecodeError:
                continue
            if data is not None:
                flat = {k: v for s in [data, *(x for x in data.values() if isinstance(x, dict))] for k, v in s.items()}
                return cls(**{f.name: flat[f.name] for f in fields(cls) if f.name in flat})
        return cls()


def assets(html: Column, base: Column) -> Column:
    """The distinct absolute URLs of style sheets, scripts and images of a page, sorted; data URLs go."""
    @F.pandas_udf("array<string>")
    def run(pages: pd.Series, bases: pd.Series) -> pd.Series:
        from html.parser import HTMLParser
        from urllib.parse import urljoin

        wanted = {"link": "href", "script": "src", "img": "src"}

        class Parser(HTMLParser):
            def handle_starttag(self, tag, attrs):
                url = dict(reversed(attrs)).get(wanted.get(tag))
                if url and not url.startswith("data:"):
                    url = url if url.startswith("http") else urljoin(self.base, url)
                    if url.startswith("http"):
                        self.found.add(url)

        def one(page, base):
            p = Parser()
            p.base, p.found = base or "", set()
            p.feed(page or "")
            return sorted(p.found)

        return pd.Series([one(x, b) for x, b in zip(pages, bases)])

    return run(html, base)
