"""Operator 8: secrets, and who else has them.

Candidates are found by pattern: assignments, access key ids, long hexadecimal strings, and tokens of well-known forms.
Their values are hashed, and over the whole corpus the distinct owners and the distinct repositories of each hash are counted.  A value
is a copied example (``copied``) if ``COPIED_OWNERS`` owners have it, or if two have it in ``COPIED_REPOSITORIES`` repositories together,
however few they are: wording that has spread from one to the other.  A value of one owner alone that looks random is a live-looking
credential (``live``), in one repository or in many, as an owner may use a key all over.  A value that two owners have in few
repositories is neither: it may be a key they share.

Counting is by hash, owner and repository first, so a value that a third of all rows hold reaches each later step as few rows.

DataFrame functions only.  Spans count code points, ends are exclusive.

Defined results: a null text counts as an empty one and has no spans; a null owner or repository is an owner or repository
of its own; repeated rows are found each, and count once as a repository; columns named like an output are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native_spans import find_spans, joined
from .shared import text_or_empty, written

#: Kinds in the order in which spans of equal start are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "token", "copied", "live"]
ASSIGN, ACCESS, HEX, TOKEN, COPIED, LIVE = range(6)

#: "password" and its like in either case, then : or =, then the value.
ASSIGNMENT = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Tokens that their issuers mark by a prefix, and signed JSON tokens.
MARKED = "(?:gh[pousr]_|glpat-|xox[abprs]-|[rs]k_live_|AIza)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{16,}\\.[A-Za-z0-9_.-]{16,}"

#: A value of so many owners, or of two owners and so many repositories, is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
#: A live-looking value has so many characters, and so many different ones, and a digit and a letter among them.
LIVE_CHARS, LIVE_DISTINCT = 16, 8


def candidates(text: Column) -> Column:
    """An array of (kind, start, end, value) of one text."""

    def of(kind: int, spans: Column, keep=None) -> Column:
        spans = F.filter(spans, keep) if keep else spans
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"]))

    return F.concat(
        of(ASSIGN, find_spans(text, ASSIGNMENT, 2), lambda s: F.length(s["value"]) >= 6),
        # a match of the base pattern is a whole run, so its least length can stand in the pattern
        of(ACCESS, find_spans(text, "AKIA[A-Z0-9]{16,}")),
        of(HEX, find_spans(text, "[0-9a-f]{24,}")),
        of(TOKEN, find_spans(text, MARKED)),
    )


def looks_live(value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    return (F.length(value) >= LIVE_CHARS) & (distinct >= LIVE_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def ownership(found: DataFrame) -> DataFrame:
    """``owners`` and ``repositories`` of each ``hash`` of a table with ``hash``, ``owner`` and ``repository``."""
    once = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))


def scan(
    df: DataFrame, owner: Column, repository: Column, text: str = "text", keep: list[str] | None = None,
    copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES,
) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``findings``: (start, kind, end, hash, owners, repositories), by start and kind.

    ``kind`` is a place in ``KINDS``; ``copied`` and ``live`` findings lie where the value of another finding lies.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("findings", "__row")]
    found = written(
        df.select(
            *[F.col(f"`{c}`") for c in keep],
            F.coalesce(owner.cast("string"), F.lit("")).alias("__owner"),
            F.coalesce(repository.cast("string"), F.lit("")).alias("__repository"),
            candidates(text_or_empty(text)).alias("__found"),
        ).withColumn("__row", F.monotonically_increasing_id()),
        "secrets",
    )
    each = found.select("__row", F.col("__owner").alias("owner"), F.col("__repository").alias("repository"), F.explode("__found").alias("f"))
    each = each.select(
        "__row", "owner", "repository", "f.kind", "f.start", "f.end", F.sha2("f.value", 256).alias("hash"), looks_live(F.col("f.value")).alias("live"),
        F.length("f.value").alias("size"),
    )
    # a written table, so that the findings of a value that very many rows hold can be split over tasks
    known = each.join(written(ownership(each), "owners"), "hash")
    # the value of an assignment stands at the end of its span
    spread = (F.col("owners") >= copied_owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= copied_repositories))
    verdict = F.when(spread, COPIED).when((F.col("owners") == 1) & F.col("live"), LIVE)
    finding = lambda kind, start: F.struct(start.alias("start"), kind.alias("kind"), F.col("end"), F.col("hash"), F.col("owners"), F.col("repositories"))
    both = known.select(
        "__row",
        F.explode(
            F.array_compact(
                F.array(
                    finding(F.col("kind"), F.col("start")),
                    F.when(verdict.isNotNull(), finding(verdict, F.col("end") - F.col("size"))),
                )
            )
        ).alias("f"),
    )
    by_row = both.groupBy("__row").agg(F.array_sort(F.collect_set("f")).alias("findings"))
    none = F.array().cast(by_row.schema["findings"].dataType)
    out = found.drop("__found", "__owner", "__repository").join(by_row, "__row", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("findings", none).alias("findings"))


def digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the ``findings`` of ``scan``."""
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda f: f["kind"] <= HEX)
    return df.select(
        key,
        of(ASSIGN).alias("n_assign"),
        of(ACCESS).alias("n_access"),
        of(HEX).alias("n_hex"),
        F.sha2(joined(KINDS, base), 256).alias("base_sha256"),
        joined(KINDS, F.col("findings")).alias("spans"),
        of(COPIED).alias("n_copied"),
        of(LIVE).alias("n_live"),
    )
