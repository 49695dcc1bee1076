"""URL filters: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

One strict term or several distinct soft terms reject a url. Hits must stand between boundaries, so that `therapist` or
`essex` do not count. Only the url column is read, rows stay where they are, and the automaton is built once per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..runtime import ship_package
from .text import ascii_lower


class Rule(NamedTuple):
    """``host`` and its subdomains, paths starting with ``path``; the longest fitting rule decides."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

#: Terms that settle the matter alone.
STRICT_TERMS = ("casino", "porn", "porno", "xxx", "sex", "viagra", "cialis", "escort", "escorts", "hentai", "milf", "camgirl", "camgirls",
                "jackpot", "roulette", "malware", "phishing", "warez", "spam")
#: Terms that also occur in harmless urls; several distinct ones are needed.
SOFT_TERMS = ("free", "cheap", "bet", "bets", "betting", "win", "winner", "pill", "pills", "ads", "ad", "track", "tracker", "tracking", "farm",
              "loan", "loans", "poker", "slots", "adult", "dating", "nude", "torrent", "crack", "keygen", "pharma", "pharmacy", "discount",
              "click", "clicks", "bonus", "hot", "girls", "replica", "payday", "download")
SOFT_NEEDED = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first `://` up to `/`, `?`, `#` or the end; path from there up to `?`, `#` or the end.

    Both are empty for a null url or one without `://`.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name of the longest rule that fits, else null; the rule table becomes one CASE, longest first."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.name).otherwise(found)
    return found


def automaton(strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS):
    """Aho-Corasick automaton whose values are (term, is strict)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for term in soft:
        machine.add_word(term, (term, False))
    for term in strict:
        machine.add_word(term, (term, True))
    machine.make_automaton()
    return machine


def term_counts(machine, text: str) -> tuple[int, int]:
    """(strict hits, distinct soft terms) whose neighbours on both sides are no letters; digits are boundaries."""
    strict, soft = 0, set()
    for end, (term, sure) in machine.iter(text):
        start = end - len(term) + 1
        if (start and text[start - 1].isalpha()) or (end + 1 < len(text) and text[end + 1].isalpha()):
            continue
        if sure:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, strict: tuple[str, ...] = STRICT_TERMS,
          soft: tuple[str, ...] = SOFT_TERMS, soft_needed: int = SOFT_NEEDED, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with host, path, rule, strict_hits, soft_hits and verdict (allow or block).

    A fitting rule decides, else the vocabulary. A null or empty url fits no rule, has no hits and is allowed. Repeated
    rows are judged alike; other columns are not read. The whole url is searched, query and fragment included.
    """
    ship_package(pages.sparkSession)
    host, path = host_and_path(F.col(url))
    parts = pages.select(*keep, F.col(url).alias("_url"), host.alias("host"), path.alias("path"))
    ruled = parts.select(*keep, "host", "path", fitting_rule(F.col("host"), F.col("path"), rules).alias("rule"),
                         F.lower(F.coalesce("_url", F.lit(""))).alias("_url"))
    schema = ruled.drop("_url").schema.add("strict_hits", LongType()).add("soft_hits", LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(strict, soft)
        for batch in batches:
            hits = [term_counts(machine, u) for u in batch.column("_url").to_pylist()]
            columns = [batch.column(c) for c in batch.schema.names if c != "_url"]
            names = [c for c in batch.schema.names if c != "_url"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())],
                                             names=[*names, "strict_hits", "soft_hits"])

    counted = ruled.mapInArrow(count, schema)
    own = F.when((F.col("strict_hits") > 0) | (F.col("soft_hits") >= soft_needed), "block").otherwise("allow")
    by_rule = F.lit(None).cast("string")
    for rule in rules:
        by_rule = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(by_rule)
    return counted.withColumn("verdict", F.coalesce(by_rule, own))
