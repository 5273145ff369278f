"""Registered domains by a list of public suffixes with wildcard and exception rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import strip
from siteloom.functions.urls import host_of, let


def suffix_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct (rule) of the lines of a public suffix list: a rule ends at white space; comments and empty lines have none.

    A rule is a suffix (co.uk), a suffix with a star for its first label (*.ck), or one with a mark for an exception (!www.ck).
    """
    rule = F.lower(F.regexp_replace(F.split(strip(F.col(line)), r"\s").getItem(0), r"^\.", ""))
    return lines.select(rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()


def _tails(host: Column) -> Column:
    """(n, suffix, key) of a host: its suffixes by number of labels, each as the three keys of rules that can match it."""

    def of(labels: Column) -> Column:
        def at(n: Column) -> Column:
            tail = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
            own, short = tail(n), F.when(n > 1, tail(n - 1))
            keys = F.array(own, F.concat(F.lit("*."), short), F.concat(F.lit("!"), own))
            return F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(n.alias("n"), own.alias("suffix"), k.alias("key")))

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), at))

    return let(F.split(host, r"\."), of)


def registered_domains(hosts: DataFrame, rules: DataFrame, small: int = 100_000) -> DataFrame:
    """(host, suffix, domain) of the distinct `host` of `hosts`: its public suffix, and that with one label before it.

    Of the rules that match, an exception holds, which takes its first label away, and else the longest; without any there
    is no suffix. The domain is null if there is no suffix or nothing before it. Each distinct host is unnested once into
    its few suffixes, which meet the rules in an equi-join: broadcast up to `small` rules, shuffled beyond.

    Hosts are compared in lower case without a dot at their end and without a port; numeric addresses have no suffix, nor
    have empty and null hosts.
    """
    clean = F.regexp_replace(F.regexp_replace(F.lower("host"), r":[0-9]*\z", ""), r"\.\z", "")
    known = hosts.select("host").distinct().withColumn("_clean", clean)
    named = known.where("_clean <> ''").where(~F.col("_clean").rlike(r"^[0-9.]+\z|^\[|\.\.|^\."))
    tails = named.select("host", "_clean", F.explode(_tails(F.col("_clean"))).alias("t")).select("host", "_clean", "t.*")
    listed = F.broadcast(rules) if rules.count() <= small else rules
    met = tails.join(listed, F.col("key") == F.col("rule"))
    out = F.startswith("key", F.lit("!"))
    length = F.when(out, F.col("n") - 1).otherwise(F.col("n"))
    best = met.groupBy("host", "_clean").agg(F.max(F.struct(out.alias("out"), length.alias("n")))["n"].alias("_n"))
    best = best.withColumn("_labels", F.split("_clean", r"\."))
    end = lambda k: F.array_join(F.slice("_labels", F.size("_labels") - k + 1, k), ".")
    found = best.select(
        F.col("host").alias("_known"), end(F.col("_n")).alias("suffix"), F.when(F.size("_labels") > F.col("_n"), end(F.col("_n") + 1)).alias("domain")
    )
    return known.select("host").join(found, F.col("host") == F.col("_known"), "left").select("host", "suffix", "domain")


def with_site(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`urls` with `site`: the registered domain of the URL's host, or the host itself if it has none."""
    rows = urls.withColumn("_host", host_of(F.col(url)))
    found = registered_domains(rows.select(F.col("_host").alias("host")), rules)
    rows = rows.join(found.select(F.col("host").alias("_host"), "domain"), "_host", "left")
    return rows.withColumn("site", F.coalesce("domain", "_host")).drop("_host", "domain")
