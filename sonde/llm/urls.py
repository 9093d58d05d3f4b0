"""URL filters: rule lists held in Bloom filter cascades, probed without a join.

A rule is a host and a path prefix such as ``example.org/es/``; it fits its host and
all subdomains. A url can only be under rules that have as many host labels and as
many path characters as some rule has, so it yields one candidate key for each such
shape. The keys of all pages are the universe of a cascade: its first filter holds
the listed keys, the second those keys of the universe that pass the first without
being listed, the third the listed keys that pass the second, and so on until none
passes wrongly. Membership is then exact for every key of the universe, and the
filters, a few bits for each listed key, are constants of the plan.

The longest fitting rule gives the verdict; urls under no rule are not listed and
therefore allowed. Null urls, and urls without ``://``, have empty host and path. A
rule in both lists blocks. Equal urls get equal results, an empty table gives an
empty result, other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonde.llm.common import table, written

#: Fixed rules of the registered query.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _UPPER, _LOWER),
            F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def shapes(rules) -> list[tuple[int, int]]:
    """Host labels and path characters of the rules."""
    return sorted({(rule.partition("/")[0].count(".") + 1, len(rule) - rule.index("/")) for rule in rules})


def candidates(host: str, path: str, rules) -> Column:
    """The keys under which a url could be listed."""
    labels = F.split(F.col(host), r"\.", -1)
    found = [F.when((F.size(labels) >= n) & (F.length(path) >= width),
                    F.concat(F.concat_ws(".", F.slice(labels, -n, n)), F.substring(F.col(path), 1, width))) for n, width in shapes(rules)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


class Level:
    """A Bloom filter: ``words`` of 64 bits, read at ``seeds`` hashes of a key."""

    def __init__(self, keys: DataFrame, n: int, rate: float, depth: int):
        hashes = max(1, round(math.log2(1 / rate)))
        self.bits = max(64, math.ceil(n * hashes / math.log(2)))
        self.seeds = [100 * depth + i for i in range(hashes)]
        at = keys.select(F.explode(F.array(*[self.place(F.col("key"), s) for s in self.seeds])).alias("bit"))
        filled = (at.groupBy(F.shiftright("bit", 6).alias("word"))
                  .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("value")).collect())
        self.words = [0] * (-(-self.bits // 64))
        for row in filled:
            self.words[row["word"]] = row["value"]

    def place(self, key: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(self.bits).cast("long"))

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words]) if len(self.words) < 64 else F.lit(self.words).cast("array<long>")
        tests = []
        for seed in self.seeds:
            bit = self.place(key, seed)
            tests.append(F.getbit(F.get(words, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1)
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out


class Cascade:
    """Exact membership of the keys of ``universe`` (key) in ``listed``."""

    def __init__(self, listed: list[str], universe: DataFrame, size: int):
        spark, self.levels = universe.sparkSession, []
        if not listed:
            return
        inside = spark.createDataFrame([(k,) for k in sorted(set(listed))], "key string")
        n, rate = len(set(listed)), min(0.5, len(set(listed)) / max(size, 1))
        here, there = inside, universe.join(inside, "key", "left_anti")
        while n:
            level = Level(here, n, rate, len(self.levels) + 1)
            self.levels.append(level)
            wrong = there.filter(level.passes(F.col("key"))).distinct()
            here, there = written(wrong, "passing"), here
            n, rate = here.count(), 0.5

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(self.levels[depth - 1].passes(key), out).otherwise(F.lit(depth % 2 == 0))
        return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    names = [rule for _, rule in rules]
    rows = (pages.select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("keys", candidates("host", "path", names)))
    universe = rows.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    blocked = {rule for verdict, rule in rules if verdict == "block"}
    lists = [("block", Cascade(sorted(blocked), universe, size)), ("allow", Cascade(sorted(set(names) - blocked), universe, size))]
    fits = F.concat(*[F.transform(F.filter("keys", lambda k: held.has(k)), lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict")))
                      for verdict, held in lists])
    return (rows.withColumn("best", F.array_max(fits))
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict")))


def op9_url_filters(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages"))


SQL = rf"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '\A([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(verdict, rule_host, rule_path) AS (VALUES {", ".join(f"('{v}', '{r[:r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)}),
fits AS (
  SELECT page_id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path DESC) AS nth
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.nth = 1
"""
QUERIES, CHECKS = {"op9_url_filters": op9_url_filters}, {"op9_url_filters": SQL}
