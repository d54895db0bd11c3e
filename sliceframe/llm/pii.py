"""Information-theoretic sanitisation of personal data.

Four kinds of protected entities are found by fixed patterns. What else reveals
them is estimated from the corpus: a term (a lower-cased word of letters, marks
and digits anywhere in a text that mentions the entity, outside mentions) discloses an entity when their pointwise mutual information,
log2(p(term, entity) / (p(term) p(entity))), reaches ``generalise`` times the
entity's own information -log2 p(entity); from ``remove`` times on it is as
good as the entity and is removed, else generalised, in every text that names
it, also where the entity itself doesn't stand. Probabilities are shares of
distinct texts, all of them, so that copies are evidence neither way; pairs seen
in fewer than ``min_support`` texts are not judged. A pair with an entity of
less than ``min_bits`` must be as unlikely by chance as ``min_support`` texts of
an entity of ``min_bits`` are; one that is in every text has nothing to disclose.
Coarser entities (domains of addresses, blocks of numbers) are judged alike, but
their terms are generalised only.

Scale: entities come from one pass over each whole text; only terms and entities
that can reach the thresholds by their own counts are paired. Document counts of terms are aggregated in part before their shuffle, over
all terms, and then joined to the surviving pairs. Disclosing terms meet the
words of every text; their table is broadcast only when a count shows it is
within ``broadcast_rows``; beyond it the same joins shuffle.

Defined results: null text counts as empty and has no spans; repeated rows are
treated alike; null ids are kept; of two verdicts on one term the stronger holds;
texts of any length are scanned whole; an empty table gives an empty result;
extra columns pass through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import as_row, durable, few, in_slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = "entities array<string>, rest string"
#: What separates terms.
TERM_BREAK = "[^\\p{L}\\p{M}\\p{N}]+"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}


def emails(text: str):
    """Leftmost matches, found from each @ so that long runs of word characters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity_of(kind: str, mention: str) -> str:
    return f"{kind}:{mention.lower() if kind in ('email', 'ip') else digits_of(mention)}"


def coarser(kind: str, mention: str) -> str:
    """What an entity shares with others: the domain of an address, the block of a number."""
    if kind == "email":
        return "domain:" + mention.lower().rpartition("@")[2]
    if kind == "ip":
        return "ip block:" + mention.rpartition(".")[0]
    return f"{kind} block:" + (digits_of(mention)[:6] if kind == "card" else digits_of(mention)[:-4])


def analyse(text: str | None) -> dict:
    """Entities with their coarser ones, and the text without their mentions, if it has any."""
    text = text or ""
    spans = base_spans(text)
    if not spans:
        return {"entities": [], "rest": None}
    found = {f(k, text[a:b]) for k, a, b in spans for f in (entity_of, coarser)}
    out, at = [], 0
    for a, b in sorted((a, b) for _, a, b in spans):
        out.append(text[at:a])
        at = max(at, b)
    return {"entities": sorted(found), "rest": " ".join([*out, text[at:]])}


@functools.cache
def words_of():
    """The pattern of runs of letters, marks and digits, as TERM_BREAK has them."""
    kept = [c for c in (*range(0x33480), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] in "LMN"]
    ends = [c for c, d in zip(kept, [*kept[1:], -1]) if d != c + 1]
    starts = [c for c, d in zip(kept, [-1, *kept[:-1]]) if d != c - 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]+")


def finder():
    """Marked as not deterministic, so that a filter on its result doesn't run it (and a second worker) again."""

    @F.arrow_udf(FOUND)
    def find(texts):
        import pyarrow as pa

        kind = pa.struct([("entities", pa.list_(pa.string())), ("rest", pa.string())])
        return in_slices(lambda ts: [analyse(t) for t in ts], kind, texts)

    return find.asNondeterministic()


def term_spans(text: str, spans: list[dict], terms: dict[str, str]) -> list[dict]:
    """Spans of disclosing terms outside the base spans."""
    taken = sorted((s["start"], s["end"]) for s in spans)
    out, i = [], 0
    for m in words_of().finditer(text):
        how = terms.get(m[0].lower())
        if how:
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                out.append({"kind": how, "start": m.start(), "end": m.end()})
    return out


def sanitised(text: str, spans: list[dict]) -> str:
    """The text with every span masked; of overlapping spans the first, longest one counts."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], MASKS[s["kind"]]]
            at = s["end"]
        elif s["end"] > at:
            at = s["end"]
    return "".join([*out, text[at:]])


def applier():
    @F.arrow_udf(f"spans {SPANS}, text string")
    def apply(texts, terms):
        import pyarrow as pa

        def masked(t, ds):
            base = [{"kind": k, "start": a, "end": b} for k, a, b in base_spans(t or "")]
            if ds:
                base += term_spans(t or "", base, {d["term"]: d["how"] for d in ds})
            return {"spans": base, "text": sanitised(t, base) if t and base else t}

        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        kind = pa.struct([("spans", pa.list_(span)), ("text", pa.string())])
        return in_slices(lambda ts, ds: list(map(masked, ts, ds)), kind, texts, terms)

    return apply.asNondeterministic()


def once(docs: DataFrame, text: str, broadcast_rows: int) -> tuple[DataFrame, int]:
    """(h, text) of every distinct text, and their number. Only texts that have copies are shuffled."""
    keyed = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    per = durable(keyed.groupBy("h").agg(F.count("*").alias("m")))
    many = few(per.where("m > 1").select("h"), broadcast_rows)
    return keyed.join(many, "h", "left_anti").unionByName(keyed.join(many, "h", "left_semi").dropDuplicates(["h"])), per.count()


def terms_of(text):
    """The different lower-cased words of letters, marks and digits of a text."""
    return F.array_remove(F.array_distinct(F.transform(F.split(text, TERM_BREAK), F.lower)), "")


def disclosures(docs: DataFrame, *, text: str = "text", min_support: int = 3, generalise: float = 0.8, remove: float = 0.95, min_bits: float = 6.0, broadcast_rows: int = 200_000) -> DataFrame:
    """(term, how) of disclosing terms; of several verdicts on a term the stricter one."""
    h = F.xxhash64(F.col(f"`{text}`"))
    found = docs.select(h.alias("h"), finder()(F.col(f"`{text}`")).alias("f"))
    held = durable(found.where(F.size("f.entities") > 0).select("h", "f.entities", "f.rest").dropDuplicates(["h"]))
    texts, n = once(docs, text, broadcast_rows)
    n = F.lit(float(max(n, 1)))
    # Neither bound loses a pair: one counted min_support times has both that often, and its share
    # reaches generalise only where n_term is at most n_both * (n / n_entity) ** (1 - generalise).
    mentions = held.select("h", F.explode("entities").alias("entity"))
    df_entity = mentions.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= min_support).withColumn("bits", F.log2(n / F.col("n_entity"))).where("bits > 0")
    df_entity = few(durable(df_entity), broadcast_rows)
    mentions = durable(mentions.join(df_entity, "entity"))
    most = F.col("n_entity") * F.pow(n / F.col("n_entity"), 1 - generalise) * 1.001
    judged_in = few(durable(mentions.groupBy("h").agg(F.max(most).alias("most"))), broadcast_rows)
    # Counted before the join, which so meets a row a word of the vocabulary and not one a mention.
    df_term = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= min_support)
    near = held.join(judged_in, "h").select("h", "most", F.explode(terms_of(F.col("rest"))).alias("term"))
    near = near.join(df_term, "term").where("n_term <= most").select("h", "term", "n_term")
    pairs = near.join(mentions, "h").where(F.col("n_term") <= most).groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"), F.first("bits").alias("bits"))
    # A word cut by a mention is counted in full elsewhere.
    pairs = pairs.withColumn("n_term", F.greatest("n_term", "n_both"))
    p, r = F.col("n_entity") / n, F.col("n_both") / F.col("n_term")
    share = F.log2(n * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.col("bits")
    rest = F.when(r < 1, (1 - r) * F.log2((1 - r) / (1 - p))).otherwise(0.0)
    evidence = F.col("n_term") * (r * F.log2(r / p) + rest)
    sure = (F.col("bits") >= min_bits) | (evidence >= min_bits * min_support)
    judged = pairs.where(F.col("n_both") >= min_support).withColumn("share", share).where((F.col("share") >= generalise) & sure)
    # A term that tells a coarser entity is not as good as the entity itself.
    full = (F.col("share") >= remove) & ~F.col("entity").rlike("^(domain|[a-z]+ block):")
    return judged.groupBy("term").agg(F.when(F.max(full), "removed").otherwise("term").alias("how"))


def masked(docs: DataFrame, *, text: str = "text", broadcast_rows: int = 200_000, **how) -> DataFrame:
    """(row, pii): the row as it was, all spans (base ones first) and the sanitised text."""
    leaks = durable(disclosures(docs, text=text, broadcast_rows=broadcast_rows, **how))
    named = docs.select(F.xxhash64(F.col(f"`{text}`")).alias("h"), F.explode(terms_of(F.col(f"`{text}`"))).alias("term"))
    if leaks.isEmpty():
        named = named.limit(0)
    by_text = named.join(few(leaks, broadcast_rows), "term").groupBy("h").agg(F.array_sort(F.collect_set(F.struct("term", "how"))).alias("terms"))
    by_text = few(durable(by_text), broadcast_rows)
    joined = docs.select(as_row(docs).alias("row"), F.xxhash64(F.col(f"`{text}`")).alias("h")).join(by_text, "h", "left")
    return joined.select("row", applier()(F.col("row").getField(text), F.col("terms")).alias("pii"))


def sanitise(docs: DataFrame, *, out: str = "pii", **how) -> DataFrame:
    """``docs`` with a struct ``out``: all spans (base ones first) and the sanitised text. A column of that name is replaced."""
    row = F.col("row")
    return masked(docs, **how).select(*[row.getField(c).alias(c) for c in docs.columns if c != out], F.col("pii").alias(out))


def stage(spark, docs: DataFrame) -> DataFrame:
    """All documents, with sanitised texts."""
    new = {"text": F.col("pii.text"), "n_chars": F.length("pii.text").cast("long")}
    return masked(docs).select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def joined_spans(spans) -> F:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    done = sanitise(docs.select("doc_id", "text"))
    spans = F.col("pii.spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return done.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(of(*KINDS)).cast("binary"), 256).alias("base_sha256"),
        joined_spans(spans).alias("spans"),
        F.size(of("term", "removed")).cast("long").alias("n_terms"),
    )
