"""Searches over saved responses by Spark's readers, with the guards a live client needs.

saved(spark, path, "openalex") gives raw records for the provider's normaliser; records() gives
them normalised, once for each identifier and capped.  A live client fetches pages with
`guarded` calls and saves them in the same form; none is built in, as the engine makes no
network calls.
"""

from __future__ import annotations

import shutil
import time
from collections import deque
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.errors import AuthenticationError, NetworkError, ProviderConfigError, ProviderError, ProviderNotFoundError, RateLimitError
from litloom.sources.normalize import NORMALIZERS

#: Where each provider's JSON response holds its records.
RECORDS = {"openalex": "results", "crossref": "message.items", "s2": "data", "semantic_scholar": "data", "doaj": "results", "core": "results", "ieee": "articles"}
#: Requests a second.
RATES = {"openalex": 5, "crossref": 1, "arxiv": 0.5, "pubmed": 3, "doaj": 2, "core": 1, "ieee": 1, "s2": 1}
#: An entry of an Atom feed; namespaces are left out.
ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, doi string, primary_category struct<_term:string>"
ARTICLE = r"(?s)<PubmedArticle[ >].*?</PubmedArticle>"


def saved(spark: SparkSession, path: str, provider: str, query_id: str = "") -> DataFrame:
    """query_id, provider, page and the raw records of saved pages, in the form that the provider's normaliser takes.

    Pages are files of one response each; any path that Spark reads will do, wildcards included.
    """
    if provider not in NORMALIZERS:
        raise ProviderNotFoundError(f"unknown provider {provider!r}")
    told = [F.lit(query_id).alias("query_id"), F.lit(provider).alias("provider"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page")]
    if provider == "arxiv":
        rows = spark.read.schema(ENTRY).option("rowTag", "entry").option("ignoreNamespace", True).xml(path)
        return rows.select(*told, "id", "title", "summary", "published", "author", "doi", F.col("primary_category._term").alias("category"))
    text = spark.read.text(path, wholetext=True)
    if provider == "pubmed":
        return text.select(*told, F.explode(F.regexp_extract_all("value", F.lit(ARTICLE), 0)).alias("raw"))
    found = F.try_variant_get(F.try_parse_json("value"), f"$.{RECORDS[provider]}", "array<variant>")
    return text.select(*told, F.explode(found).alias("v")).select("query_id", "provider", "page", F.to_json("v").alias("raw"))


def records(spark: SparkSession, path: str, provider: str, query_id: str = "", most: int | None = None) -> DataFrame:
    """Normalised records of saved pages: of one identifier the first, and `most` at the most."""
    from litloom.operators.runs import collected

    rows = normalizer(provider)(saved(spark, path, provider, query_id))
    rows = rows.withColumns({"query_id": F.lit(query_id), "doi": F.col("external_ids.doi"), "idx": F.monotonically_increasing_id()})
    return collected(rows, most).drop("doi", "idx")


def error_for(status: int, retry_after: float | None = None) -> ProviderError | None:
    """The error that an answer's status stands for; none for a good one."""
    if status < 400:
        return None
    if status == 429:
        return RateLimitError("too many requests", status=status, retry_after=retry_after)
    if status in (401, 403):
        return AuthenticationError("access refused", status=status)
    if status >= 500:
        return NetworkError("the provider failed", status=status)
    return ProviderError(f"request refused with status {status}", status=status)


def headers(provider: str, key: str | None = None, email: str | None = None) -> dict[str, str]:
    """Request headers: who asks, and the key where the provider takes it as a header."""
    out = {"User-Agent": f"litloom ({email})" if email else "litloom", "Accept": "application/json"}
    if key and provider in ("s2", "semantic_scholar"):
        out["x-api-key"] = key
    if key and provider == "core":
        out["Authorization"] = f"Bearer {key}"
    return out


def normalizer(provider: str):
    if provider not in NORMALIZERS:
        raise ProviderNotFoundError(f"unknown provider {provider!r}")
    return NORMALIZERS[provider]


class TokenBucket:
    """At most `rate` requests a second on average, `capacity` at once."""

    def __init__(self, rate: float, capacity: int | None = None, clock: Callable[[], float] = time.monotonic):
        if rate <= 0:
            raise ProviderConfigError("rate must be positive")
        self.rate, self.capacity, self.clock = rate, capacity if capacity is not None else max(1, int(rate * 5)), clock
        self.tokens, self.at = float(self.capacity), clock()

    def _refill(self) -> None:
        now = self.clock()
        self.tokens = min(self.capacity, self.tokens + (now - self.at) * self.rate)
        self.at = now

    def consume(self, n: int = 1) -> bool:
        self._refill()
        if self.tokens < n:
            return False
        self.tokens -= n
        return True

    def wait_time(self, n: int = 1) -> float:
        self._refill()
        return max(0.0, (n - self.tokens) / self.rate)


class SlidingWindow:
    """At most `most` requests in any `seconds`."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock, self.times = most, seconds, clock, deque()

    def allow(self) -> bool:
        now = self.clock()
        while self.times and self.times[0] <= now - self.seconds:
            self.times.popleft()
        if len(self.times) >= self.most:
            return False
        self.times.append(now)
        return True


def limited(bucket: TokenBucket, sleep: Callable[[float], None] = time.sleep):
    """A decorator: each call first waits for a token."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args, **kwargs):
            while not bucket.consume():
                sleep(bucket.wait_time())
            return f(*args, **kwargs)

        return run

    return wrap


def guarded(f: Callable, provider: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Callable:
    """f(...) -> (status, body), at the provider's rate, its bad answers as errors, some of them tried again."""
    bucket = TokenBucket(RATES.get(provider, 1), clock=clock)

    def once(*args, **kwargs):
        status, body = f(*args, **kwargs)
        error = error_for(status)
        if error is not None:
            raise error
        return body

    return with_retries(limited(bucket, sleep)(once), tries, sleep=sleep)


def pages(fetch: Callable[[str | None], tuple[list, str | None]], most: int | None = None) -> list:
    """All records of a paged search: fetch(cursor) gives a page and the next cursor, none at the end."""
    out, cursor = [], None
    while most is None or len(out) < most:
        rows, cursor = fetch(cursor)
        out += rows
        if not rows or cursor is None:
            break
    return out if most is None else out[:most]


def download(fetch: Callable[[], tuple[bytes, str]], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """A PDF: what is none, or a web page, counts as a failed try."""

    def once() -> bytes:
        content, kind = fetch()
        if not content.startswith(b"%PDF") or (kind or "").lower().startswith("text/html"):
            raise NetworkError("no PDF", content_type=kind)
        return content

    return with_retries(once, tries, sleep=sleep)()


def tool(*names: str) -> str | None:
    """Path of the first of some programs that this machine has, such as one that recognises text."""
    return next(filter(None, map(shutil.which, names)), None)


def with_retries(f: Callable, tries: int = 3, first: float = 1.0, factor: float = 2.0, on: tuple = (NetworkError, RateLimitError), sleep: Callable[[float], None] = time.sleep):
    """Calls f until it works; waits first, first * factor, ... between tries, or as long as the error asks."""

    def run(*args, **kwargs):
        for n in range(tries):
            try:
                return f(*args, **kwargs)
            except on as e:
                if n == tries - 1:
                    raise
                sleep(getattr(e, "details", {}).get("retry_after") or first * factor**n)

    return run


def pdf_candidates(docs):
    """docs with pdf_url and pdf_source: the record's own PDF link, else arXiv, else the resolvers by DOI, in this order."""
    direct = F.when(F.lower("url").rlike(r"\.pdf($|\?)"), F.col("url"))
    arxiv = F.when(F.coalesce("arxiv_id", F.lit("")) != "", F.concat(F.lit("https://arxiv.org/pdf/"), F.col("arxiv_id"), F.lit(".pdf")))
    doi = F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("https://doi.org/"), F.col("doi")))
    source = F.when(direct.isNotNull(), "direct").when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi")
    return docs.withColumns({"pdf_url": F.coalesce(direct, arxiv, doi), "pdf_source": source})


def is_pdf(content, content_type):
    return (F.substring(content, 1, 4) == F.lit(b"%PDF")) & ~F.coalesce(F.startswith(F.lower(content_type), F.lit("text/html")), F.lit(False))
