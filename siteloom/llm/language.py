"""Language identification by Bayesian evidence fusion: text, declared markup language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_batches, salt_of, saved, spread_join

_HIDDEN = re.compile(r"<(script|style|head)(?![a-zA-Z0-9_])", re.I)
_HIDDEN_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style", "head")}
_SLOTS = 1 << 14


def visible(page: str) -> str:
    """A page without tags, comments, scripts, styles and head, each replaced by a space, in one pass.

    What never ends is looked for once: then a comment or script without an end is a tag, and a tag without an end is text.
    """
    out, at, lost = [], 0, set()

    def end_of(kind: str, begin: int) -> int:
        if kind in lost:
            return -1
        if kind in _HIDDEN_END:
            found = _HIDDEN_END[kind].search(page, begin)
            found = found.end() if found else -1
        else:
            found = page.find(kind, begin)
            found = found + len(kind) if found >= 0 else -1
        if found < 0:
            lost.add(kind)
        return found

    while (begin := page.find("<", at)) >= 0:
        out.append(page[at:begin])
        hidden = _HIDDEN.match(page, begin)
        end = end_of(hidden[1].lower(), hidden.end()) if hidden else end_of("-->", begin + 4) if page.startswith("<!--", begin) else -1
        end = end if end >= 0 else end_of(">", begin)
        out.append(" " if end >= 0 else "<")
        at = end if end >= 0 else begin + 1
    return "".join([*out, page[at:]])


def _grams(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams of a text, ASCII letters folded, runs of other ASCII bytes as one space."""
    raw = np.frombuffer(b" ".join([b"", *text.translate(_LETTERS).split(), b""]), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    codes = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return ((codes * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def train_grams(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", sample: int = 8_000) -> tuple[list[str], np.ndarray]:
    """(languages, log probability of each trigram slot by language), from at most `sample` rows with the least id hashes."""
    ids = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(lang_col).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.where("lang IS NOT NULL").join(F.broadcast(ids), "_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                sums.setdefault(lang, np.zeros(_SLOTS, np.int64))
                sums[lang] += np.bincount(_grams(text), minlength=_SLOTS)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())],
                ["lang", "slot", "n"],
            )

    counts = rows.mapInArrow(run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toPandas()
    langs = sorted(found["lang"].unique())
    table = np.full((len(langs), _SLOTS), 0.5)
    for k, lang in enumerate(langs):
        own = found[found["lang"] == lang]
        table[k, own["slot"].to_numpy()] += own["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def identify_languages(
    pages: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "page_id", url_col: str = "url",
    html_col: str = "html", strength: float = 5.0, trigrams: float = 40.0,
) -> DataFrame:
    """Per page: id, url, `lang` (most probable), `p_lang`, `text_lang`, `declared`, `suffix`, `host`.

    The text gives a log likelihood for each language, tempered as if it had at most `trigrams` independent trigrams.
    From all pages, grouped sums of the text's posteriors then give how often pages of a language declare each language,
    have each address suffix, and stand on each host. A host's prior is its own sum smoothed with that of its registered
    domain, which is smoothed with that of its top-level domain, and that with all pages', each by `strength` pseudo-pages. The
    result is the product of prior, text and both pieces of evidence.

    Pages with no text, no declaration (null html) or no host (null url) fall back on the evidence that is left. Sums have a
    row for each task and host before they are shuffled, and priors return to pages over salts, so a host with a third of
    the pages is spread. A registered domain is the last two labels of a host, three where the last is a country and the one
    before it a kind (co, com, org, net, gov, ac, edu); an address of numbers is its own. Repeated rows count each; other
    columns are ignored; ties go to the first language by name. A model without languages gives every page with `lang`,
    `p_lang` and `text_lang` null. An empty table gives an empty result.
    """
    langs, table = model
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(table)
    host = F.coalesce(F.lower(F.expr(f"try_parse_url(`{url_col}`, 'HOST')")), F.lit(""))
    tag = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    last = F.regexp_extract("host", r"\.([a-z]+)$", 1)
    path = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z]+://[^/]*/([a-zA-Z]{2})(?:/|$)", 1))
    rows = pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"),
        F.coalesce(F.when(tag.isin(langs), tag).when(tag != "", F.lit("other")), F.lit("")).alias("declared"),
        path.alias("_path"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"),
    )
    # a two-letter suffix, or a path that begins with a known language, says something; other suffixes say the same
    suffix = F.when(F.col("_path").isin(langs), F.concat(F.lit("/"), "_path")).when(F.length(last) == 2, last)
    rows = rows.withColumn("suffix", F.coalesce(suffix, F.lit("")))
    rows = rows.withColumn("tld", last)
    numbers = F.regexp_like("host", F.lit(r"^[0-9.]+$|:"))
    domain = F.regexp_extract("host", r"((?:[^.]+\.(?=(?:co|com|org|net|gov|ac|edu)\.[a-z]{2}$))?[^.]+\.[^.]+)$", 1)
    rows = rows.withColumn("domain", F.when(numbers, F.col("host")).otherwise(domain))
    if not langs:
        none = F.lit(None).cast("string")
        return rows.select(
            F.col("_id").alias(id_col), F.col("_url").alias(url_col), none.alias("lang"), F.lit(None).cast("double").alias("p_lang"),
            none.alias("text_lang"), "declared", "suffix", "host",
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page in batch.column(len(kept)).to_pylist():
                grams = _grams(visible(page).encode("utf-8", "replace"))
                log = shared.value[:, grams].sum(axis=1) * (min(1.0, trigrams / len(grams)) if len(grams) else 0.0)
                out.append((log - log.max()).tolist())
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kept = ["_id", "_url", "host", "domain", "tld", "declared", "suffix"]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = rows.select(*kept, "_html").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", log array<double>")
    scored = saved(scored, "text-likelihoods")
    mass = [F.exp(F.col("log")[k]) for k in range(len(langs))]
    whole = sum(mass[1:], mass[0])
    # millionths, so that sums do not depend on their order
    soft = [F.sum(F.round(1e6 * m / whole).cast("long")).alias(f"n{k}") for k, m in enumerate(mass)]
    names = [f"n{k}" for k in range(len(langs))]

    def again(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))

    hosts = saved(scored.groupBy("tld", "domain", "host").agg(*soft), "hosts")
    seen = scored.groupBy("declared", "suffix").agg(*soft)
    # a row for each pair of a known language and a two-letter suffix at most
    evidence = [r.asDict() for r in seen.collect()]
    totals = np.array([[r[n] for n in names] for r in evidence], float).reshape(len(evidence), len(langs)) / 1e6
    base = totals.sum(axis=0)

    def likelihoods(column: str):
        values = sorted({r[column] for r in evidence})
        out = {}
        for v in values:
            own = sum((t for r, t in zip(evidence, totals) if r[column] == v), np.zeros(len(langs)))
            out[v] = np.log((own + 0.5) / (base + 0.5 * len(values))).tolist() if v else [0.0] * len(langs)
        pairs = [(v, x) for v, x in out.items()]
        return F.broadcast(pages.sparkSession.createDataFrame(pairs, f"{column} string, _{column} array<double>"))

    if not evidence:
        empty = "lang string, p_lang double, text_lang string, declared string, suffix string, host string"
        schema = f"{id_col} {kinds['_id']}, {url_col} {kinds['_url']}, {empty}"
        return pages.sparkSession.createDataFrame([], schema)

    def smoothed(child: DataFrame, parent: list, prefix: str) -> list:
        n = sum((F.col(x) for x in names[1:]), F.col(names[0])) / 1e6
        return [((F.col(x) / 1e6 + strength * p) / (n + strength)).alias(f"{prefix}{k}") for k, (x, p) in enumerate(zip(names, parent))]

    top = [F.lit(float(x)) for x in (base + 1) / (base + 1).sum()]
    by_tld = again(hosts, "tld").select("tld", *smoothed(hosts, top, "s"))
    # a row for each top-level domain, of which names have a bounded number; hosts of one are spread over salts
    by_tld = saved(by_tld, "by-tld")
    by_domain = again(hosts, "tld", "domain").withColumn("_salt", F.pmod(F.xxhash64("domain"), F.lit(64)))
    by_domain = spread_join(by_domain, by_tld, ["tld"], "_salt")
    by_domain = by_domain.select("tld", "domain", *smoothed(by_domain, [F.col(f"s{k}") for k in range(len(langs))], "d"))
    own = hosts.withColumn("_salt", F.pmod(F.xxhash64("host"), F.lit(64)))
    by_host = spread_join(own, by_domain, ["tld", "domain"], "_salt")
    prior = F.array(*(F.log(p) for p in smoothed(by_host, [F.col(f"d{k}") for k in range(len(langs))], "h")))
    by_host = by_host.select("host", prior.alias("_prior"))
    found = spread_join(scored.withColumn("_salt", salt_of("_id", 64, run=1)), by_host, ["host"], "_salt")
    found = found.join(likelihoods("declared"), "declared").join(likelihoods("suffix"), "suffix")
    parts = ("log", "_declared", "_suffix", "_prior")
    logs = F.array(*(F.round(sum((F.col(c)[k] for c in parts), F.lit(0.0)), 9) for k in range(len(langs))))
    found = found.withColumn("_logs", logs)
    best = F.array_position("_logs", F.array_max("_logs")).cast("int")
    share = 1 / F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_logs")))
    known = F.array(*(F.lit(x) for x in langs))
    text_best = F.array_position("log", F.array_max("log")).cast("int")
    return found.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), known[best - 1].alias("lang"), share.alias("p_lang"),
        F.when(F.array_min("log") < 0, known[text_best - 1]).alias("text_lang"), "declared", "suffix", "host",
    )
