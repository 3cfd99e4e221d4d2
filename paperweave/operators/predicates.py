"""Row predicates of the crawl, the stored graph and the document cache."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days a cached document stays fresh, by endpoint; negative: forever.
TTL_DAYS = {"authors": -1, "references": -1, "citations": 7, "paper": -1, "author_papers": 7}


def _words(rule: str) -> list[str]:
    return [w for w in rule.split(" ") if w]


def keyword_match(title: Column, rules: list[str] | None) -> Column:
    """Whether a title has all words of any rule, as substrings without case.

    No rules (or only empty ones) match everything, a null title too; otherwise a null title matches nothing.
    """
    alts = [reduce(lambda a, b: a & b, (F.contains(F.lower(title), F.lit(w.lower())) for w in _words(r))) for r in rules or [] if _words(r)]
    return F.coalesce(reduce(lambda a, b: a | b, alts), F.lit(False)) if alts else F.lit(True)


def hash_keyword_match(title_hash: Column, rules: list[str] | None, normalize: bool = True) -> Column:
    """The same over a title hash: case-sensitive against lower-case hashes unless ``normalize`` folds the rules' words."""
    def word(w: str) -> Column:
        text = "".join(c for c in w.lower() if c.isascii() and c.isalnum() or "一" <= c <= "龥") if normalize else w
        return F.contains(title_hash, F.lit(text))

    alts = [reduce(lambda a, b: a & b, map(word, _words(r))) for r in rules or [] if _words(r)]
    return F.coalesce(reduce(lambda a, b: a | b, alts), F.lit(False)) if alts else F.lit(True)


def crawl_predicate(year: Column, title: Column, since: int, rules: list[str] | None) -> Column:
    """The crawl filter: year unknown or not before ``since`` (inclusive), and a keyword match."""
    return (year.isNull() | (year >= since)) & keyword_match(title, rules)


def stored_predicate(year: Column, title_hash: Column, since: int, rules: list[str] | None, normalize: bool = True) -> Column:
    """The stored graph's filter: here an unknown year does not pass."""
    return F.coalesce(year >= since, F.lit(False)) & hash_keyword_match(title_hash, rules, normalize)


def fresh(fetched_at: Column, endpoint: Column, now: Column, ttl: dict[str, int] | None = None) -> Column:
    """Whether a cached document may still be used; unknown endpoints don't expire, an unknown time has expired."""
    days = F.coalesce(reduce(lambda c, kv: c.when(endpoint == kv[0], F.lit(kv[1])), list((ttl or TTL_DAYS).items())[1:], F.when(endpoint == next(iter(ttl or TTL_DAYS)), F.lit(next(iter((ttl or TTL_DAYS).values()))))), F.lit(-1))
    return (days < 0) | F.coalesce(now < fetched_at + F.make_dt_interval(days), F.lit(False))
