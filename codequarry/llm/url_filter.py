"""URL filter by a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in one pass over a URL (lower case); a hit counts where no ASCII
letter or digit stands at either side. A strict term rejects by itself, soft terms when at least `soft_needed` distinct ones
occur. `weight` sums the weights of the distinct terms.

Defined results: a null or empty URL has no hits and isn't rejected; a null page_id is kept; repeated rows repeat; a
term found twice counts once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import ship

STRICT = {x: 1.0 for x in ("porn", "xxx", "spam", "viagra", "cialis", "payday-loan", "casino", "escort", "warez", "phishing", "malware")}
SOFT = {"cheap": 0.3, "pills": 0.5, "free": 0.2, "bet": 0.4, "bets": 0.4, "betting": 0.5, "win": 0.3, "ads": 0.4, "track": 0.3, "tracker": 0.4, "adult": 0.4, "sex": 0.5, "loan": 0.4, "loans": 0.4, "discount": 0.3, "farm": 0.1, "click": 0.3, "popup": 0.5, "slots": 0.5, "poker": 0.5, "replica": 0.4, "torrent": 0.4}
SOFT_NEEDED = 2
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def automaton(strict: dict[str, float], soft: dict[str, float]):
    import ahocorasick

    auto = ahocorasick.Automaton()
    for term, weight in soft.items():
        auto.add_word(term, (term, False, weight))
    for term, weight in strict.items():
        auto.add_word(term, (term, True, weight))
    auto.make_automaton()
    return auto


def hits(url: str, auto) -> set[tuple[str, bool, float]]:
    out = set()
    for end, found in auto.iter(url):
        start = end - len(found[0])
        if (start < 0 or url[start] not in _WORD) and (end + 1 == len(url) or url[end + 1] not in _WORD):
            out.add(found)
    return out


def judge_urls(pages: DataFrame, strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT, soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """(page_id, url, strict_hits, soft_hits, weight, rejected) for every page."""
    ship(pages.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(strict, soft)
        for batch in batches:
            found = [hits(u, auto) if u else set() for u in pc.ascii_lower(batch.column("url")).to_pylist()]
            n_strict = [sum(s for _, s, _ in x) for x in found]
            n_soft = [len(x) - n for x, n in zip(found, n_strict, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(n_strict, pa.int64()), pa.array(n_soft, pa.int64()), pa.array([round(sum(w for _, _, w in x), 6) for x in found], pa.float64()), pa.array([a > 0 or b >= soft_needed for a, b in zip(n_strict, n_soft, strict=True)], pa.bool_())],
                ["page_id", "url", "strict_hits", "soft_hits", "weight", "rejected"],
            )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(judge, "page_id long, url string, strict_hits long, soft_hits long, weight double, rejected boolean")


def oracle(strict: dict[str, float] = STRICT, soft: dict[str, float] = SOFT, soft_needed: int = SOFT_NEEDED) -> str:
    values = ", ".join(f"('{t}', {s}, {w})" for terms, s in ((strict, 1), (soft, 0)) for t, w in terms.items())
    return f"""
WITH terms(term, strict, weight) AS (VALUES {values}),
found AS (
  SELECT u.url, sum(strict) AS strict_hits, sum(1 - strict) AS soft_hits, sum(weight) AS weight
  FROM (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL) u JOIN terms ON regexp_matches(lower(u.url), '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')
  GROUP BY u.url)
SELECT p.page_id, p.url, CAST(coalesce(strict_hits, 0) AS BIGINT) AS strict_hits, CAST(coalesce(soft_hits, 0) AS BIGINT) AS soft_hits,
  round(CAST(coalesce(weight, 0) AS DOUBLE), 6) AS weight, coalesce(strict_hits > 0 OR soft_hits >= {soft_needed}, false) AS rejected
FROM pages p LEFT JOIN found f ON p.url = f.url"""
