"""Operator 9: personal data, and the terms that give it away.

Base entities (e-mail addresses, IP addresses, payment cards, telephone numbers) are found by pattern and check.  Other words of
a row may reveal an entity as well.  How strongly is estimated from the corpus: with N rows, n(e) rows that hold the entity, n(t)
rows that hold the term and n(t,e) rows that hold both, the term's pointwise mutual information with the entity is
log(N n(t,e) / (n(t) n(e))), and the entity's own information is log(N / n(e)).  A term, of any length and anywhere in the row, that
gives a share of that information above a threshold (``SHARE``) discloses the entity: in the rows that hold the entity it is reported
as a ``term`` span wherever it stands.  Terms are words outside the entities.

A pair counts from ``ROWS`` rows on.  One row is no evidence: with H words that a corpus holds once, H / N of them fall into any row by
chance, whereas hardly any word is in the same two rows by chance.  Copies count as rows, so they are better removed before.

Entities that the same rows hold are one *class*, as each term tells the same of all of them.  So a row of very many addresses that are
nowhere else, or in one other row alone, is one class for its terms and not as many pairs as it has addresses and words.

``sanitise`` replaces entities by their kind.  A disclosing term is generalised to its longest beginning (and ``*``) that some word
which begins so brings into so many rows that it gives less than the share of the information; if no letter may stay, ``*`` alone does.

DataFrame functions only.  Spans count code points, ends are exclusive.

Defined results: a null text has no spans and stays null; rows without entities are returned as they are; repeated rows are
treated alike and each counts; columns named like an output are replaced; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import find_spans, joined, spliced
from .shared import by_place, place_of, sent, text_or_empty, written

#: Kinds in the order in which they are listed; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "term"]
EMAIL, IP, CARD, PHONE, TERM = range(5)

LOCAL = "A-Za-z0-9._%+-"
EMAILS = f"(?:\\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IPS = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARDS = "[0-9](?:[\\x20-]?[0-9])++"
PHONES = "\\+[0-9][\\x20().0-9-]+[0-9]"

WORD, OTHER = "\\p{L}+", "[^\\p{L}]+"
#: A term discloses if it gives this share of the entity's information, seen with it in so many rows.
SHARE, ROWS = 0.8, 2


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(2 * c.try_cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def entities(text: Column) -> Column:
    """An array of (kind, start, end, match) of the base entities of one text."""

    def of(kind: int, pattern: str, keep=None) -> Column:
        spans = find_spans(text, pattern)
        spans = F.filter(spans, keep) if keep else spans
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["match"]))

    def byte_parts(s: Column) -> Column:
        return F.forall(F.split(s["match"], "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))

    return F.concat(
        of(EMAIL, EMAILS),
        of(IP, IPS, byte_parts),
        of(CARD, CARDS, lambda s: F.length(digits(s["match"])).between(16, 19) & luhn(digits(s["match"]))),
        of(PHONE, PHONES, lambda s: F.length(digits(s["match"])).between(8, 15)),
    )


def value_of(kind: Column, match: Column) -> Column:
    """What is the same for all ways to write an entity."""
    return F.concat_ws(":", kind, F.when(kind.isin(CARD, PHONE), digits(match)).otherwise(F.lower(match)))


def masked(text: Column, found: Column) -> Column:
    """``text`` with spaces where the entities ``found`` stand."""
    ordered = F.array_sort(F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))))
    return spliced(text, ordered, lambda e, at: F.repeat(F.lit(" "), F.greatest(e["end"] - F.greatest(e["start"], at), F.lit(0))))


def words(text: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.split(text, OTHER)), lambda w: F.lower(w)))


def row_counts(texts: DataFrame) -> DataFrame:
    """``n_term``: in how many rows of ``texts`` (column ``t``) each word occurs, over all rows.

    All words are counted within each task before anything is joined or shuffled, so frequent words cost no more than rare ones.
    """
    each = texts.select(F.explode(words(F.col("t"))).alias("term")).filter("term <> ''")
    return each.groupBy("term").agg(F.count("*").alias("n_term"))


def detected(df: DataFrame, text: str, keep: list[str], whole: bool) -> DataFrame:
    """A written table of the columns ``keep``, ``__found``, ``__row``, and ``__text`` (if not ``whole``, of rows with entities alone)."""
    out = df.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias("__text"), entities(text_or_empty(text)).alias("__found"))
    if not whole:
        out = out.withColumn("__text", F.when(F.size("__found") > 0, F.col("__text")))
    return written(out.withColumn("__row", F.monotonically_increasing_id()), "pii")


def classes(table: DataFrame, rows: int) -> DataFrame:
    """``row``, ``class`` and ``n_value``: the classes of the entities of each row that so many rows hold."""
    each = table.select(F.col("__row").alias("row"), F.explode("__found").alias("e"))
    values = written(each.select("row", value_of(F.col("e.kind"), F.col("e.match")).alias("value")).distinct(), "values")
    held = values.groupBy("value").agg(F.count("*").alias("n_value"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", "row")).alias("y"))
    held = held.filter(F.col("n_value") >= rows).select("value", "n_value", F.concat_ws(":", "n_value", "x", "y").alias("class"))
    # what is joined is written, so that the rows of a frequent value can be split over tasks
    return written(values.join(sent(written(held, "held")), "value").select("row", "class", "n_value").distinct(), "classes")


def disclosing(near: DataFrame, texts: DataFrame, share: float, rows: int, general: bool) -> DataFrame:
    """``class``, ``term``, ``share`` and ``shown`` of the terms that disclose a class of ``near`` (``row``, ``class``, ``n_value``, ``term``)."""
    pairs = near.groupBy("class", "n_value", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= rows)
    pairs = written(pairs, "pairs")
    total = F.lit(float(max(texts.count(), 1)))
    counts = written(row_counts(texts), "words") if general else row_counts(texts)
    # an inner join with counted words: a semi join would be moved below the count, and meet each word of each row
    counted = written(counts.join(pairs.select("term").distinct(), "term"), "terms")
    out = pairs.join(counted, "term")
    mutual = F.log(total * F.col("n_both") / (F.col("n_term") * F.col("n_value")))
    own = F.log(total / F.col("n_value"))
    # an entity that all rows hold tells nothing
    out = out.withColumn("share", F.when(own > 0, mutual / own).otherwise(0.0)).filter(F.round("share", 9) >= share)
    if not general:
        return out.select("class", "term", "share", F.lit("*").alias("shown"))
    out = written(out.select("class", "term", "share", own.alias("own")), "told")
    begins = F.explode(F.sequence(F.lit(1), F.length("term") - 1)).alias("size")
    begins = out.filter(F.length("term") > 1).select("class", "term", "own", begins).withColumn("begin", F.substring("term", F.lit(1), F.col("size")))
    wanted = sent(written(begins.select(F.col("begin").alias("b")).distinct(), "begins"))
    each = counts.select("n_term", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda k: F.substring("term", F.lit(1), k))).alias("b"))
    most = each.join(wanted, "b").groupBy("b").agg(F.max("n_term").alias("most"))
    # a beginning is in as many rows at least as the most frequent word that begins so
    safe = begins.join(most, begins["begin"] == most["b"]).filter(F.round(F.log(total / F.col("most")) / F.col("own"), 9) < share)
    safe = safe.groupBy("class", "term").agg(F.max("size").alias("size"))
    kept = F.substring("term", F.lit(1), F.coalesce("size", F.lit(0)))
    return out.join(safe, ["class", "term"], "left").select("class", "term", "share", F.concat(kept, F.lit("*")).alias("shown"))


FINDING = "struct<kind:int,start:int,end:int,share:double,shown:string>"


def finding(kind: Column, start: Column, end: Column, share: Column, shown: Column) -> Column:
    parts = {"kind": kind, "start": start, "end": end, "share": share, "shown": shown}
    return F.struct(*[c.alias(n) for n, c in parts.items()]).cast(FINDING)


def terms(table: DataFrame, texts: DataFrame, share: float, rows: int, general: bool) -> DataFrame:
    """``__row`` and ``__terms``, the disclosing terms of a row of ``detected``."""
    held = classes(table, rows)
    by_row = written(held.groupBy("row").agg(F.collect_list(F.struct("class", "n_value")).alias("own")), "rows")
    body = table.select(F.col("__row").alias("row"), "__text", "__found").join(by_row, "row")
    body = written(body.select("row", "own", masked(F.col("__text"), F.col("__found")).alias("t")), "masked")
    near = body.select("row", "own", F.explode(words(F.col("t"))).alias("term")).filter("term <> ''")
    near = near.select("term", F.explode("own").alias("c")).select("term", "c.class", "c.n_value")
    told = written(disclosing(near, texts, share, rows, general), "disclosing")
    # the share is the greatest and the form the shortest that a class of the row asks for
    here = held.join(told, "class").groupBy("row", "term").agg(F.max("share").alias("share"), F.min(F.struct(F.length("shown"), "shown"))["shown"].alias("shown"))
    here = written(here, "here")
    own = body.join(sent(written(here.select("row").distinct(), "informed")), "row", "left_semi")
    spans = own.select("row", F.explode(find_spans(F.col("t"), WORD)).alias("w")).select("row", F.lower("w.match").alias("term"), "w.start", "w.end")
    spans = spans.join(here, ["row", "term"])
    each = finding(F.lit(TERM), F.col("start"), F.col("end"), F.col("share"), F.col("shown"))
    return spans.groupBy(F.col("row").alias("__row")).agg(F.array_sort(F.collect_list(each)).alias("__terms"))


def with_findings(table: DataFrame, by_row: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    base = F.transform("__found", lambda e: finding(e["kind"], e["start"], e["end"], F.lit(1.0), F.get(names, e["kind"])))
    none = F.array().cast(f"array<{FINDING}>")
    out = table.join(by_row, "__row", "left")
    return out.withColumn("findings", F.array_sort(F.concat(base, F.coalesce("__terms", none))))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None, share: float = SHARE, rows: int = ROWS) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``findings``: (kind, start, end, share, shown), by kind and start; ``share`` is 1 but for terms."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("findings", "__row", "__text", "__found", "__terms")]
    table = detected(df, text, keep, whole=False)
    by_row = terms(table.filter(F.size("__found") > 0), df.select(text_or_empty(text).alias("t")), share, rows, general=False)
    return with_findings(table, by_row).select(*[F.col(f"`{c}`") for c in keep], "findings")


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the ``findings`` of ``find``."""
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return df.select(
        key,
        of(EMAIL).alias("n_email"),
        of(IP).alias("n_ip"),
        of(CARD).alias("n_card"),
        of(PHONE).alias("n_phone"),
        F.sha2(joined(KINDS, F.filter("findings", lambda f: f["kind"] < TERM)), 256).alias("base_sha256"),
        joined(KINDS, F.col("findings")).alias("spans"),
        of(TERM).alias("n_term"),
    )


def redacted(text: Column, findings: Column) -> Column:
    """``text`` with each finding replaced by what is shown of it; findings that overlap become one, named by the first."""
    ordered = F.array_sort(F.transform(findings, lambda f: F.struct(*[f[k].alias(k) for k in ("start", "kind", "end", "shown")])))
    return spliced(text, ordered, lambda f, at: F.when(f["start"] >= at, f["shown"]).otherwise(""))


def sanitise(df: DataFrame, text: str = "text", share: float = SHARE, rows: int = ROWS) -> DataFrame:
    """``df`` with its ``text`` sanitised.  Entities are found once; rows without any pass by."""
    own, placed = place_of(df, text), by_place(df)
    table = detected(placed, own, placed.columns, whole=True)
    has = F.size("__found") > 0
    by_row = terms(table.filter(has), table.select(F.col("__text").alias("t")), share, rows, general=True)
    new = with_findings(table.filter(has), by_row).withColumn(own, redacted(F.col("__text"), F.col("findings")))
    return table.filter(~has).select(*placed.columns).unionByName(new.select(*placed.columns)).toDF(*df.columns)
