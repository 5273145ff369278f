"""Personal data by pattern, and information-theoretic sanitisation of the terms that reveal it. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import saved, spread_join

KINDS = ("email", "ip", "card", "phone", "secret", "term")
_BASE, _SECRET, _TERM = 4, 4, 5
#: Java forms of the base patterns with the same leftmost, non-overlapping matches. Possessive repeats and the conditions
#: on what stands before keep a long run without a match linear: only its start, or the end of the last match, can begin one.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A value of twelve characters or more with a digit, after a label for what must not be known. The value is read to its end
#: before the digit is asked for, and the next label is looked for behind it, so each character is read a few times at most.
_LABEL = (
    r"(?:[a-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|passphrase|apikey|api[_-]key|access[_-]key|private[_-]key)"
    r"[\x22']?\s{0,3}[:=]\s{0,3}[\x22']?"
)
_SECRETS = rf"(?i)(?<![\p{{L}}\p{{N}}]){_LABEL}[A-Za-z0-9_+/=-]{{12,}}+"
_PART = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)"
_SPANS = "array<struct<start:int,stop:int,hit:string>>"
_BLOCK = 64
_ORDERS = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, also where the body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: Column) -> Column:
    """Matches of a regex as (start, stop, hit), in code points: the gaps between matches give the places.

    Lengths are summed inside blocks of matches, then over blocks, so thousands of matches in a text stay cheap.
    """
    empty = F.array().cast(_SPANS)
    zero = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def moved(spans: Column, by: Column) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct((s["start"] + by).alias("start"), (s["stop"] + by).alias("stop"), s["hit"].alias("hit")),
        )

    def add(a: Column, x: Column) -> Column:
        n, at = F.coalesce(F.length(x["hit"]), F.lit(0)), a["at"] + F.length(x["gap"])
        span = F.struct(at.alias("start"), (at + n).alias("stop"), x["hit"].alias("hit"))
        return F.struct((at + n).alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def chain(a: Column, x: Column) -> Column:
        return F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["spans"], moved(x["spans"], a["at"])).alias("spans"))

    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    blocks = _let(
        parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p), F.lit(_BLOCK)), lambda k: F.slice(p, k, _BLOCK))
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
    spans = F.aggregate(sums, zero, chain)["spans"]
    return F.when(F.regexp_like(text, pattern), F.filter(spans, lambda s: s["hit"].isNotNull())).otherwise(empty)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        d = F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int"))
        return F.when(d > 9, d - 9).otherwise(d)

    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(hit, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.when(F.length(_digits(hit)).between(12, 19), _luhn(_digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Valid matches of the four base kinds as (start, kind index, stop, hit), by start, then kind."""

    def of(index: int, kind: str) -> Column:
        found = F.filter(located(text, F.lit(_PATTERNS[kind])), lambda s: _valid(kind, s["hit"]))
        return F.transform(
            found,
            lambda s: F.struct(s["start"].alias("start"), F.lit(index).alias("kind"), s["stop"].alias("stop"), s["hit"].alias("hit")),
        )

    return F.array_sort(F.concat(*(of(i, k) for i, k in enumerate(KINDS[:_BASE]))))


def secret_spans(text: Column) -> Column:
    """Labelled secrets as (start, kind index, stop, hit); the span is the value without its label."""

    def value(s: Column) -> Column:
        hit = F.regexp_replace(s["hit"], f"^(?i){_LABEL}", "")
        return F.struct((s["stop"] - F.length(hit)).alias("start"), F.lit(_SECRET).alias("kind"), s["stop"].alias("stop"), hit.alias("hit"))

    return F.filter(F.transform(located(text, F.lit(_SECRETS)), value), lambda s: s["hit"].rlike("[0-9]"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
    )


def _terms(text: Column) -> Column:
    """Distinct words of letters, three or more, outside e-mail addresses, labelled values and strings with a digit.

    What a pattern names itself, the label of a secret, is no term: it would stand with every secret by construction.
    """
    bare = F.when(text.contains("@"), F.regexp_replace(text, _PATTERNS["email"], " ")).otherwise(text)
    bare = F.when(text.rlike("[:=]"), F.regexp_replace(bare, _SECRETS, " ")).otherwise(bare)
    bare = F.regexp_replace(bare, r"(?<![\p{L}\p{N}_+/=-])[\p{L}_+/=-]*+[0-9][\p{L}\p{N}_+/=-]*+", " ")
    return F.filter(F.array_distinct(F.split(F.lower(bare), r"[^\p{L}]+")), lambda t: F.length(t) >= 3)


def _with_family(terms: Column) -> Column:
    """(ts, h0, h1, h2): terms and their least digests in three orders. Near copies share nearly all terms, and so at least one."""

    def least(digests: Column, k: int) -> Column:
        part = F.array_min(F.transform(digests, lambda d: F.substring(d, 8 * k + 1, 8)))
        return F.conv(part, 16, 10).cast("long").alias(f"h{k}")

    def of(ts: Column) -> Column:
        digests = F.transform(ts, lambda t: F.md5(t.cast("binary")))
        return _let(digests, lambda d: F.struct(ts.alias("ts"), *(least(d, k) for k in range(_ORDERS))))

    return _let(terms, of)


def entities_of(spans: Column) -> Column:
    """The protected entities of a row at the levels that recur: each value, its group, and its kind.

    Groups are the domain of an address, the network of an ip, the issuer digits of a card and the area of a phone number.
    """

    def value(s: Column) -> Column:
        return F.when(s["kind"] == 0, F.lower(s["hit"])).when(s["kind"] == _SECRET, s["hit"]).otherwise(_digits(s["hit"]))

    def group(s: Column) -> Column:
        return (
            F.when(s["kind"] == 0, F.lower(F.regexp_extract(s["hit"], "@(.*)$", 1)))
            .when(s["kind"] == 1, F.regexp_extract(s["hit"], r"^[0-9]+\.[0-9]+\.[0-9]+", 0))
            .when(s["kind"] == 2, F.substring(_digits(s["hit"]), 1, 6))
            .when(s["kind"] == 3, F.substring(_digits(s["hit"]), 1, 4))
        )

    levels = [
        F.transform(spans, lambda s: F.concat_ws(":", F.lit("value"), s["kind"].cast("string"), value(s))),
        F.transform(F.filter(spans, lambda s: s["kind"] < _SECRET), lambda s: F.concat_ws(":", F.lit("group"), s["kind"].cast("string"), group(s))),
        F.transform(spans, lambda s: F.concat_ws(":", F.lit("kind"), s["kind"].cast("string"))),
    ]
    return F.array_distinct(F.concat(*levels))


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.95, generalise_at: float = 0.85,
    evidence: float = 20.0, small: int = 1_000_000,
) -> DataFrame:
    """Per row: id, counts and `base_sha256` of the base spans, `spans` (base, secrets and terms), `found` (the same as an
    array) and `removed_terms`.

    Protected entities are the values of the base spans and of labelled secrets, their groups and their kinds
    (`entities_of`). Document counts over the whole corpus estimate how strongly a term t reveals an entity c:
    PMI(c; t) / IC(c) = log(N n_ct / (n_c n_t)) / log(N / n_c), which is 1 if t occurs only with c. A term is removed from
    all documents if this reaches `remove_at` for any entity, and generalised if it reaches `generalise_at`, also where the
    document does not hold c itself. What is estimated must not be chance: t and c stand together in two documents at
    least, and n_ct log(N / n_c), the information by which chance would have to be beaten, is `evidence` nats at least. Nor
    must it be copying: the texts in which they stand together are no near copies of one text, whose every word would
    tell: of three least digests of their words each differs between some of them, and the first has a value for every two
    of them at least.

    An entity that all documents hold reveals nothing; one in a single document leaves nothing to estimate. Counts go
    through partial sums, so an entity in a third of all documents is no hot key. One pass over the words of all texts keeps
    where the terms that came so far stand; these are broadcast if there are at most `small` of them and joined otherwise.
    Terms are compared in lower case; a word of a case that differs from its lower case by more than single letters may go
    unmarked. Texts of any length take time in proportion to it. Null text counts as
    empty; rows that repeat id and text count once and are reported each; null ids are allowed; other columns are ignored;
    an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumn("_key", F.concat_ws(":", F.col("_id").cast("string"), F.xxhash64("_text").cast("string")))
    spans = [base_spans(F.col("_text")).alias("base"), secret_spans(F.col("_text")).alias("secrets")]
    base = saved(rows.select("_id", "_key", *spans), "base-spans")

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= small else df

    keys = base.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    counted = keys.agg(F.count(F.lit(1)), F.max("_n")).first()
    n = counted[0]
    # each row once: texts are shuffled only if a row repeats both id and text
    once = rows.select("_key", "_text") if (counted[1] or 1) == 1 else rows.select("_key", "_text").dropDuplicates(["_key"])
    held = base.where(F.size("base") + F.size("secrets") > 0).select("_key", F.explode(entities_of(F.concat("base", "secrets"))).alias("c"))
    held = held.distinct()
    entities = held.groupBy("c").agg(F.count(F.lit(1)).alias("n_c")).where((F.col("n_c") >= 2) & (F.col("n_c") < n))
    entities = saved(entities, "entities")
    known = saved(held.join(few(entities), "c").groupBy("_key").agg(F.collect_list(F.struct("c", "n_c")).alias("cs")), "holders")
    families = [f"h{k}" for k in range(_ORDERS)]
    # the words of the texts that hold an entity are written, as three steps read them
    holders = once.join(few(known), "_key").select("_key", "cs", _with_family(_terms(F.col("_text"))).alias("f"))
    holders = saved(holders, "holder-terms")
    with_terms = holders.select("_key", "cs", *(f"f.{h}" for h in families), F.explode("f.ts").alias("t"))
    ends = [f(h).alias(f"{n}_{h}") for h in families for n, f in (("low", F.min), ("high", F.max))]
    pairs = with_terms.select(F.explode("cs").alias("x"), "t", *families).groupBy("x.c", "x.n_c", "t").agg(F.count(F.lit(1)).alias("n_ct"), *ends)
    for h in families:
        pairs = pairs.where(F.col(f"low_{h}") < F.col(f"high_{h}"))
    pairs = pairs.select("c", "n_c", "t", "n_ct")
    pairs = pairs.where((F.col("n_ct") >= 2) & (F.col("n_ct") * F.log(F.lit(float(n)) / F.col("n_c")) >= evidence))
    total = F.lit(float(n))

    def share(n_t: Column) -> Column:
        pmi = F.log(total * F.col("n_ct") / (F.col("n_c") * n_t))
        return F.round(pmi / F.log(total / F.col("n_c")), 9)

    # a term is in as many documents at least as hold an entity and have it: most common words are out by that alone
    seen = with_terms.groupBy("t").agg(F.count(F.lit(1)).alias("_seen"))
    pairs = saved(pairs.join(seen, "t").where(share(F.col("_seen")) >= generalise_at).drop("_seen"), "pairs")
    # what is left are few pairs: of the texts in which they stand together, half at least are of families of their own
    again = with_terms.select(F.explode("cs.c").alias("c"), "t", "h0").join(few(pairs.select("c", "t")), ["c", "t"])
    own = again.groupBy("c", "t").agg(F.countDistinct("h0").alias("_families"))
    pairs = saved(pairs.join(own, ["c", "t"]).where("2 * _families >= n_ct").drop("_families"), "own-pairs")
    wanted = saved(pairs.select("t").distinct(), "terms")
    # the words of all texts are read once: where the wanted ones stand gives their counts and, later, what is marked
    stand = rows.select("_key", F.explode(_terms(F.col("_text"))).alias("t")).join(few(wanted), "t", "left_semi")
    stand = saved(stand.select("_key", "t"), "standing-terms")
    counts = (stand if (counted[1] or 1) == 1 else stand.distinct()).groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    telling = pairs.join(counts, "t").withColumn("share", share(F.col("n_t"))).where(F.col("share") >= generalise_at)
    telling = saved(telling.select("c", "t", (F.col("share") >= remove_at).alias("out")), "telling")
    # a term discloses its entity wherever it stands, so it is looked for in all documents
    terms = saved(telling.groupBy("t").agg(F.max("out").alias("out")), "telling-terms")
    if terms.count() <= small:
        hits = stand.join(F.broadcast(terms), "t")
    else:
        hits = spread_join(stand.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(64))), terms, ["t"], "_salt")
    marked = saved(hits.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("t", "out"))).alias("_found")), "marked")
    pattern = F.concat(
        F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.transform("_found", lambda x: x["t"]), "|"), F.lit(r")(?!\p{L})")
    )
    spans = rows.join(few(marked), "_key").select("_key", "_found", located(F.col("_text"), pattern).alias("_hits"))
    spans = spans.groupBy("_key").agg(F.first("_found").alias("_found"), F.first("_hits").alias("_hits"))
    term = lambda s: F.struct(s["start"].alias("start"), F.lit(_TERM).alias("kind"), s["stop"].alias("stop"), s["hit"].alias("hit"))
    found = base.join(spans, "_key", "left")
    extra = F.coalesce(F.transform("_hits", term), F.array().cast("array<struct<start:int,kind:int,stop:int,hit:string>>"))
    gone = F.coalesce(F.transform(F.filter("_found", lambda x: x["out"]), lambda x: x["t"]), F.array().cast("array<string>"))
    every = F.array_sort(F.concat("base", "secrets", extra))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("_id").alias(id_col),
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:_BASE])),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"),
        F.size(extra).cast("long").alias("n_term"),
        F.size(every).cast("long").alias("n_spans"),
        every.alias("found"),
        gone.alias("removed_terms"),
    )


def sanitised(text: Column, found: Column, removed_terms: Column) -> Column:
    """A text with base spans replaced by their kind, and terms removed or generalised to [WORD]; overlaps go once."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:_TERM]))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a: Column, s: Column) -> Column:
        word = F.when(F.array_contains(removed_terms, F.lower(s["hit"])), F.lit("")).otherwise(F.lit("[WORD]"))
        mark = F.when(s["kind"] < _TERM, F.get(marks, s["kind"])).otherwise(word)
        step = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), mark)
        ahead = s["start"] >= a["at"]
        return F.struct(
            F.when(ahead, s["stop"]).otherwise(F.greatest(a["at"], s["stop"])).alias("at"),
            F.when(ahead, step).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(found, zero, add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)))
