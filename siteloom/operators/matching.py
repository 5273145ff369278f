"""Resolving companies against registries: candidate search, transparent scores, and a gap rule that refuses to guess."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import fixed
from siteloom.functions.text import comparable_name, company_number, digits, filled, strip
from siteloom.sources.scratch import saved

_SCORE = "decimal(8,2)"


def _d(x: Column | str) -> Column:
    return (F.lit(x) if isinstance(x, str) else x).cast(_SCORE)


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp similarity of two strings, 0 to 1; the first is that of the website."""

    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(left, right)])

    return F.pandas_udf(ratios, "double")(a, b)


def _common_lengths(left: list[str], right: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of strings of at most 64 characters, all pairs side by side.

    A pair's state is one bit for each character of the left string; a step takes the next character of all right strings.
    """
    codes = [np.zeros((len(left), max(map(len, some), default=0)), dtype=np.int32) for some in (left, right)]
    for table, some, none in zip(codes, (left, right), (-1, -2)):
        table += none
        for k, text in enumerate(some):
            table[k, : len(text)] = [ord(c) for c in text]
    bits = np.left_shift(np.uint64(1), np.arange(codes[0].shape[1], dtype=np.uint64))
    state = np.full(len(left), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(codes[1].shape[1]):
        equal = ((codes[0] == codes[1][:, i : i + 1]) * bits).sum(axis=1, dtype=np.uint64)
        met = state & equal
        state = (state + met) | (state - met)
    lengths = np.array([len(x) for x in left])
    used = (np.uint64(1) << lengths.clip(0, 63).astype(np.uint64)) - np.uint64(1)
    used[lengths >= 64] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.bitwise_count(~state & used).astype(np.int64)


def _common_length(left: str, right: str) -> int:
    """The same for one pair of any length, on whole numbers."""
    places: dict[str, int] = {}
    for k, c in enumerate(left):
        places[c] = places.get(c, 0) | 1 << k
    used = state = (1 << len(left)) - 1
    for c in right:
        met = state & places.get(c, 0)
        state = ((state + met) | (state - met)) & used
    return (~state & used).bit_count()


def edit_distance(a: Column, b: Column) -> Column:
    """How many characters are deleted and inserted to make one string of the other; null counts as empty."""

    def distances(left: pd.Series, right: pd.Series) -> pd.Series:
        left, right = ([x or "" for x in some] for some in (left, right))
        out = np.zeros(len(left), np.int64)
        short = [k for k, (x, y) in enumerate(zip(left, right)) if max(len(x), len(y)) <= 64]
        out[short] = _common_lengths([left[k] for k in short], [right[k] for k in short]) if short else 0
        for k in set(range(len(left))) - set(short):
            out[k] = _common_length(left[k], right[k])
        return pd.Series([len(x) + len(y) for x, y in zip(left, right)] - 2 * out)

    return F.pandas_udf(distances, "long")(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Likeness of two names by their sets of words, 0 to 100: the words that both have, alone and with the rest of either
    name, compared two by two, and the best of it. Names are compared in lower case by their ASCII letters and digits; null
    if one is null, 0 if one has no words.

    Sets and lengths are column expressions. Only the distance between the rests needs a step in Python, on Arrow batches.
    """

    def words(c: Column) -> Column:
        clean = F.regexp_replace(F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "")), "[^a-z0-9]+", " ")
        return F.array_sort(F.array_distinct(F.filter(F.split(clean, " "), lambda w: w != "")))

    left, right = words(a), words(b)
    both = F.array_join(F.array_intersect(left, right), " ")
    rests = [F.array_join(F.array_except(x, y), " ") for x, y in ((left, right), (right, left))]
    distance = edit_distance(*rests).cast("double")
    n = F.length(both).cast("double")
    gap = F.when(n > 0, 1.0).otherwise(0.0)
    size = [F.length(r).cast("double") for r in rests]
    ratio = lambda d, total: F.lit(100.0) - F.lit(100.0) * d / F.nullif(total, F.lit(0.0))
    whole = ratio(distance, 2 * (n + gap) + size[0] + size[1])
    parts = [ratio(gap + m, 2 * n + gap + m) for m in size]
    best = F.when(n > 0, F.greatest(whole, *parts)).otherwise(whole)
    empty = (F.size(left) == 0) | (F.size(right) == 0)
    same = (n > 0) & ((size[0] == 0) | (size[1] == 0))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(empty, 0).when(same, 100).otherwise(F.bround(best, 0)).cast("int"))


def _grams(text: Column, size: int) -> Column:
    """Distinct parts of `size` characters of a text, none if it is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


#: Characters of the parts on which names are joined.
_PART = 8


def name_search(companies: DataFrame, registry: DataFrame, most: int = 25) -> DataFrame:
    """Registry entities (entity, name) whose name contains that of a company (key, search_name), `most` for each, by name.

    Containment is no equality, so names are first joined on a part of `_PART` characters: every part of the searched name
    must be in the other, and the one that fewest entities have is taken, by counts over the registry. Shorter names are
    parts themselves. Parts of three characters would be shared by more entities the larger the registry is. All joins are equi-joins; the first `most` of a company are kept by a limit inside
    each task before they are shuffled, so a company that thousands of entities match is no hot key.
    """
    wanted = companies.select("key", F.upper(strip(F.col("search_name"))).alias("_name")).where("_name <> ''")
    names = registry.select("entity", "name", F.upper("name").alias("_upper"))
    searched = saved(wanted.select("_name").distinct(), "searched")
    found = []
    # the registry is cut into parts of the sizes that are searched, mostly one
    sizes = sorted((r[0] for r in searched.select(F.least(F.length("_name"), F.lit(_PART))).distinct().collect()), reverse=True)
    for size in sizes or [_PART]:
        here = searched.where((F.length("_name") >= _PART) if size == _PART else (F.length("_name") == size))
        listed = names.select("entity", "name", "_upper", F.explode(_grams(F.col("_upper"), size)).alias("_gram"))
        if size == _PART:
            parts = here.select("_name", F.explode(_grams(F.col("_name"), _PART)).alias("_gram"))
            wanted_grams = parts.select("_gram").distinct()
            counts = listed.join(wanted_grams, "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
            # a part that no entity has counts 0: then nothing matches
            ranked = parts.join(counts, "_gram", "left").groupBy("_name")
            here = ranked.agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram"))["_gram"].alias("_gram"))
        else:
            here = here.select("_name", F.col("_name").alias("_gram"))
        found.append(here.join(listed, "_gram").where(F.contains("_upper", "_name")).select("_name", "entity", "name"))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    both = wanted.join(every, "_name").select("key", "entity", "name").distinct()
    order = Window.partitionBy("key").orderBy("name", "entity")
    return both.withColumn("hit_ord", F.row_number().over(order)).where(F.col("hit_ord") <= most)


def uk_scores(pairs: DataFrame) -> DataFrame:
    """Scored pairs of a website (search_name, postal_code, full_address, city, domain) and a registry hit (title,
    company_status, address struct): name 40, postcode 25, address 15, domain 10, active 10."""
    pairs = pairs.withColumn("_a", comparable_name(F.col("search_name"), fixed.UK_NAME_RULES))
    pairs = pairs.withColumn("_b", comparable_name(F.col("title"), fixed.UK_NAME_RULES))
    pairs = pairs.withColumn("_ratio", similarity(F.col("_a"), F.col("_b")))
    a, b = F.col("_a"), F.col("_b")
    name = F.when((a == b) | F.contains(b, a) | F.contains(a, b), 40.0).otherwise(F.col("_ratio") * 40)
    pc = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    given = F.regexp_extract(F.upper(F.coalesce("full_address", F.lit(""))), r"\b([A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}|\d{4,5})\b", 1)
    x, y = pc(F.coalesce(filled(F.col("postal_code")), filled(given))), pc(F.col("address.postal_code"))
    near = (F.length(x) >= 4) & (F.length(y) >= 4) & (F.left(x, F.lit(4)) == F.left(y, F.lit(4)))
    postcode = F.when(x == y, 25).when(near, 10).otherwise(0)
    town, area = (filled(F.upper(strip(F.col(f"address.{k}")))) for k in ("locality", "region"))
    city, place = filled(F.upper(strip(F.col("city")))), F.upper(F.coalesce("full_address", F.lit("")))
    address = F.when(town == city, 15).when(F.contains(place, town), 8).when(town.isNotNull() & F.contains(place, area), 5).otherwise(0)
    host = F.replace(F.split_part(F.regexp_replace(F.lower("domain"), "^https?://", ""), F.lit("/"), F.lit(1)), F.lit("www."), F.lit(""))
    stem, land = strip(F.split_part(host, F.lit("."), F.lit(1))), F.lower(F.coalesce("address.country", F.lit("")))
    home = F.endswith(host, F.lit(".co.uk")) | F.endswith(host, F.lit(".org.uk")) | land.rlike("united kingdom|england|scotland")
    domain = F.when(F.col("domain").isNotNull() & (host != ""), F.when((F.length(stem) >= 3) & F.contains(F.upper("title"), F.upper(stem)), 7).otherwise(0) + F.when(home, 3).otherwise(0)).otherwise(0)
    active = F.when(F.lower("company_status").isin("active", "administration", "in-administration", "in administration"), 10).otherwise(0)
    parts = {"name": name, "postcode": postcode, "address": address, "domain": domain, "active": active}
    zero = F.lit(0.0)
    total = F.round(sum((F.coalesce(p.cast("double"), zero) for p in parts.values()), zero), 2)
    detail = F.struct(*(_d(F.round(F.coalesce(p.cast("double"), zero), 2)).alias(k) for k, p in parts.items()))
    return pairs.withColumn("score", _d(total)).withColumn("detail", detail).drop("_a", "_b", "_ratio")


def ny_scores(pairs: DataFrame, by_words: bool = False) -> DataFrame:
    """Scored pairs of a website (search_name, city, postal_code) and a New York entity: name 40, city 20, ZIP 20, county 10,
    type 10, and 5 for the same ZIP. Names are compared by sequence, or by their sets of words (`by_words`)."""
    pairs = pairs.withColumn("_a", comparable_name(F.col("search_name"), fixed.NY_NAME_RULES))
    pairs = pairs.withColumn("_b", comparable_name(F.col("current_entity_name"), fixed.NY_NAME_RULES))
    likeness = token_set_ratio(F.col("_a"), F.col("_b")) / 100 if by_words else similarity(F.col("_a"), F.col("_b"))
    pairs = pairs.withColumn("_ratio", likeness)
    a, b, zero = F.col("_a"), F.col("_b"), F.lit(0.0)
    near = F.when(F.contains(b, a) | F.contains(a, b), F.greatest(F.col("_ratio") * 40, F.lit(35.0))).otherwise(F.col("_ratio") * 40)
    name = F.when((a == "") | (b == ""), 0.0).when(a == b, 40.0).otherwise(F.round(near, 2))
    city, other = filled(F.col("city")), filled(F.col("dos_process_city"))
    cu, ou = F.upper(city), F.upper(other)
    town = F.when(strip(cu) == strip(ou), 20).when(F.contains(ou, cu) | F.contains(cu, ou), 10).otherwise(0)
    zx, zy = (F.left(digits(F.col(c)), F.lit(5)) for c in ("postal_code", "dos_process_zip"))
    same = (zx == zy) & (zx != "")
    code = F.when(same, 20).when((F.length(zx) >= 3) & (F.left(zx, F.lit(3)) == F.left(zy, F.lit(3))), 8).otherwise(0)
    low, county = F.lower(city), F.lower(filled(F.col("county")))
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for p in fixed.NY_BOROUGHS.items() for x in p)), low)
    area = F.when(F.contains(county, mapped), 10).when(F.contains(county, low) | F.contains(low, county), 5).otherwise(0)
    kind = F.when(filled(F.col("entity_type")).isNotNull(), 10).otherwise(0)
    parts = {"name": name, "city": town, "zip": code, "county": area, "entity_type": kind, "zip_exact_bonus": F.when(same, 5).otherwise(0)}
    total = F.round(sum((F.coalesce(p.cast("double"), zero) for p in parts.values()), zero), 2)
    detail = F.struct(*(_d(F.round(F.coalesce(p.cast("double"), zero), 2)).alias(k) for k, p in parts.items()))
    return pairs.withColumn("score", _d(total)).withColumn("detail", detail).drop("_a", "_b", "_ratio")


def best_and_gap(scored: DataFrame, key: str = "key", order: str = "hit_ord", most: int = 10) -> DataFrame:
    """The best candidate of each key with `gap` to the next (0 if there is none) and its `most` best as `candidates`."""
    by = Window.partitionBy(key).orderBy(F.desc("score"), order)
    rows = scored.withColumn("_n", F.row_number().over(by)).withColumn("_next", F.lead("score", 1).over(by))
    rows = rows.withColumn("gap", _d(F.col("score") - F.coalesce("_next", F.lit("0").cast(_SCORE)))).where(F.col("_n") <= most)
    other = [c for c in scored.columns if c != key]
    top = rows.where("_n = 1").drop("_n", "_next")
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*other).alias("c")))).alias("_l"))
    return top.join(lists.select(key, F.transform("_l", lambda x: x["c"]).alias("candidates")), key)


def uk_decision(score: Column, gap: Column, name: Column, active: Column) -> Column:
    """(status, method, confidence): an exact active name ahead by 5, or 70 points ahead by 15; else no guess."""
    exact = (name >= 39) & (active >= 10) & (score >= 50) & (gap >= 5)
    scored = (score >= 70) & (gap >= 15)
    share = F.round(score / 100, 4).cast("decimal(6,4)")
    return F.struct(
        F.when(exact | scored, "resolved").when(score >= 60, "ambiguous").otherwise("unresolved").alias("status"),
        F.when(exact, "exact_name_verified").when(scored, "name_search_scored").alias("method"),
        F.when(exact, F.lit("0.95").cast("decimal(6,4)")).otherwise(share).alias("confidence"),
    )


def resolve_uk(companies: DataFrame, search: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row for each company (key and website fields): status, company_number, method, confidence, score, gap, candidates.

    A company with a registration number is looked up; else its name is searched among `search` (query, hit_ord, ...);
    a company with neither is skipped. `profiles` has company_number.
    """
    companies = companies.withColumn("search_name", F.coalesce(filled(F.col("legal_name")), filled(F.col("company_name"))))
    number = company_number(F.col("registration_number"))
    direct = companies.where(filled(F.col("registration_number")).isNotNull()).withColumn("_number", number)
    known = profiles.select(F.col("company_number").alias("_number"), F.lit(True).alias("_known")).distinct()
    kinds = "struct<status:string,method:string,confidence:decimal(6,4)>"
    none = F.lit(None)
    direct = direct.join(known, "_number", "left").select(
        "key", "search_name", F.col("_number").alias("company_number"),
        F.when(F.col("_known"), F.struct(F.lit("resolved_direct"), F.lit("registration_number"), F.lit(1)).cast(kinds))
        .otherwise(F.struct(F.lit("not_found"), none, none).cast(kinds)).alias("d"), none.cast(_SCORE).alias("score"), none.cast(_SCORE).alias("gap"),
    )
    direct = direct.withColumn("candidates", none)
    rest = companies.where(filled(F.col("registration_number")).isNull())
    named = rest.where("search_name IS NOT NULL")
    scored = uk_scores(named.join(search, F.col("search_name") == F.col("query")))
    found = best_and_gap(scored.select("key", "hit_ord", "company_number", "title", "company_status", "score", "detail"))
    kind = dict(found.dtypes)["candidates"]
    found = found.withColumn("d", uk_decision(F.col("score"), F.col("gap"), F.col("detail.name"), F.col("detail.active")).cast(kinds))
    hits = named.select("key", "search_name").join(
        found.select("key", "company_number", "d", "score", "gap", "candidates"), "key", "left"
    ).withColumn("d", F.coalesce("d", F.struct(F.lit("not_found"), none, none).cast(kinds)))
    hits = hits.withColumn("company_number", F.when(F.col("d.status") == "resolved", F.col("company_number")))
    skipped = rest.where("search_name IS NULL").select(
        "key", "search_name", none.cast("string").alias("company_number"), F.struct(F.lit("skipped"), none, none).cast(kinds).alias("d"),
        none.cast(_SCORE).alias("score"), none.cast(_SCORE).alias("gap"), none.alias("candidates"),
    )
    direct, skipped = (t.withColumn("candidates", F.col("candidates").cast(kind)) for t in (direct, skipped))
    every = direct.unionByName(hits).unionByName(skipped)
    return every.select("key", "search_name", "company_number", "d.*", "score", "gap", "candidates")


def resolve_ny(companies: DataFrame, entities: DataFrame, by_words: bool = False) -> DataFrame:
    """One row for each company: status, dos_id, matched_name, confidence, score, gap and candidates among `entities` whose
    name contains the company's; of close candidates, the only one with the website's ZIP wins. `candidates` are the ten best
    with their scores in parts; see `ny_scores` for `by_words`."""
    companies = companies.withColumn("search_name", strip(F.coalesce(filled(F.col("legal_name")), filled(F.col("company_name")), F.lit(""))))
    hits = name_search(companies, entities.select(F.col("dos_id").alias("entity"), F.col("current_entity_name").alias("name")))
    pairs = hits.select("key", "hit_ord", F.col("entity").alias("dos_id")).join(entities, "dos_id").join(
        companies.select("key", "search_name", "city", "postal_code"), "key"
    )
    scored = ny_scores(pairs, by_words)
    zx = F.left(digits(F.col("postal_code")), F.lit(5))
    here = filled(F.col("postal_code")).isNotNull() & (F.left(digits(F.coalesce("dos_process_zip", F.lit(""))), F.lit(5)) == zx) & (F.col("score") >= 50)
    every = Window.partitionBy("key")
    scored = scored.withColumn("_here", here).withColumn("_alone", F.count_if("_here").over(every) == 1)
    best = best_and_gap(scored.select("key", "hit_ord", "dos_id", "current_entity_name", "score", "detail"))
    only = scored.where("_here AND _alone").select("key", F.col("dos_id").alias("_id"), F.col("current_entity_name").alias("_name"), F.col("score").alias("_score"))
    best = best.join(only, "key", "left")
    turned = (F.col("score") >= 50) & (F.col("gap") < 15) & F.col("_id").isNotNull()
    best = best.select(
        "key", F.when(turned, F.col("_id")).otherwise(F.col("dos_id")).alias("dos_id"),
        F.when(turned, F.col("_name")).otherwise(F.col("current_entity_name")).alias("matched_name"),
        F.when(turned, F.col("_score")).otherwise(F.col("score")).alias("score"), F.when(turned, _d("15")).otherwise(F.col("gap")).alias("gap"),
        "candidates",
    )
    resolved = (F.col("score") >= 65) & (F.col("gap") >= 15)
    status = F.when(F.col("search_name") == "", "skipped").when(F.col("score").isNull(), "not_found").when(resolved, "resolved").when(F.col("score") >= 50, "ambiguous").otherwise("unresolved")
    share = F.round(F.when(resolved, F.least(F.col("score") / 100 + 0.1, F.lit(1.0))).otherwise(F.col("score") / 100), 4).cast("decimal(6,4)")
    rows = companies.select("key", "search_name").join(best, "key", "left").withColumn("status", status)
    shown = F.col("status").isin("resolved", "ambiguous")
    return rows.select(
        "key", "search_name", "status", (F.col("status") == "resolved").alias("matched"), F.when(shown, F.col("dos_id")).alias("dos_id"),
        F.when(shown, F.col("matched_name")).alias("matched_name"), share.alias("confidence"), "score", "gap", "candidates",
    )
