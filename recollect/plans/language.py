"""Queries on questions in words, and on the texts around them (STR, DT)."""

from __future__ import annotations

import importlib.util
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import querytext as T
from ..functions import tokenizers
from ..sources import moments as M
from .core import NAMES, query, with_points

#: A Monday noon: 2026-08-17T12:00Z.
CLOCK = 1786968000000


@contextmanager
def zone(spark: SparkSession, name: str = "UTC"):
    """The session's zone while a plan is made; expressions keep it."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", name)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


#: (query, first instant, last instant before the next second or the clock, text to embed, "where did I leave" form, nothing but time)
D, NOW = "T23:59:59.999", "2026-08-17T12:00:00.000"
CASES: list[tuple[str, str | None, str | None, str, bool, bool]] = [
    ("where is my laptop", None, None, "laptop", False, False),
    ("find the keys", None, None, "keys", False, False),
    ("show me a phone", None, None, "phone", False, False),
    ("where did i leave my wallet", None, None, "wallet", True, False),
    ("the cup", None, None, "cup", False, False),
    ("where is", None, None, "where is", False, False),
    ("where'd I put the red mug", None, None, "red mug", True, False),
    ("night stand", None, None, "stand", False, False),
    ("my keys yesterday", "2026-08-16", "2026-08-16" + D, "keys", False, False),
    ("what did i see yesterday", "2026-08-16", "2026-08-16" + D, "", False, True),
    ("the day before yesterday", "2026-08-15", "2026-08-15" + D, "", False, True),
    ("mug last week", "2026-08-10", "2026-08-16" + D, "mug", False, False),
    ("mug this week", "2026-08-17", NOW, "mug", False, False),
    ("bike last month", "2026-07-01", "2026-07-31" + D, "bike", False, False),
    ("bike this month", "2026-08-01", NOW, "bike", False, False),
    ("umbrella last night", "2026-08-16T18:00:00.000", "2026-08-17T00:00:00.000", "umbrella", False, False),
    ("umbrella tonight", None, None, "umbrella", False, False),
    ("dog the weekend before last", "2026-08-08", "2026-08-09" + D, "dog", False, False),
    ("dog last weekend", "2026-08-15", "2026-08-16" + D, "dog", False, False),
    ("dog over the weekend", "2026-08-15", "2026-08-16" + D, "dog", False, False),
    ("car a fortnight ago", "2026-08-03", "2026-08-09" + D, "car", False, False),
    ("car 3 days ago", "2026-08-14", "2026-08-14" + D, "car", False, False),
    ("car two weeks back", "2026-08-03", "2026-08-09" + D, "car", False, False),
    ("car a couple of months ago", "2026-06-01", "2026-06-30" + D, "car", False, False),
    ("car a few minutes ago", "2026-08-17T11:57:00.000", NOW, "car", False, False),
    ("car a minute ago", "2026-08-17T11:59:00.000", NOW, "car", False, False),
    ("car an hour ago", "2026-08-17T11:00:00.000", NOW, "car", False, False),
    ("last tuesday", "2026-08-11", "2026-08-11" + D, "", False, True),
    ("cup on tuesday", "2026-08-11", "2026-08-11" + D, "cup", False, False),
    ("cup on monday", "2026-08-17", "2026-08-17" + D, "cup", False, False),
    ("cup last monday", "2026-08-10", "2026-08-10" + D, "cup", False, False),
    ("cup next friday", None, None, "cup next", False, False),
    ("boots in april", "2026-04-01", "2026-04-30" + D, "boots", False, False),
    ("boots in december", "2025-12-01", "2025-12-31" + D, "boots", False, False),
    ("lamp today", "2026-08-17", NOW, "lamp", False, False),
    ("lamp this morning", "2026-08-17", NOW, "lamp", False, False),
    ("lamp in the last hour", "2026-08-17T11:00:00.000", NOW, "lamp", False, False),
    ("lamp just now", "2026-08-17T11:50:00.000", NOW, "lamp", False, False),
    ("August 1", "2026-08-01", "2026-08-01" + D, "", False, True),
    ("September 5", "2025-09-05", "2025-09-05" + D, "", False, True),
    ("5 сентября", "2025-09-05", "2025-09-05" + D, "", False, True),
    ("sept 5th", "2025-09-05", "2025-09-05" + D, "", False, True),
    ("february 31", None, None, "february 31", False, False),
    ("february 29", "2024-02-29", "2024-02-29" + D, "", False, True),
    ("april 31", None, None, "april 31", False, False),
    ("wallet on september 5", "2025-09-05", "2025-09-05" + D, "wallet", False, False),
    ("What did I see on September 5?", "2025-09-05", "2025-09-05" + D, "", False, True),
    ("at home on september 5", "2025-09-05", "2025-09-05" + D, "at home", False, False),
    ("in my backpack", None, None, "in my backpack", False, False),
    ("keys yesterday on september 5", "2025-09-05", "2025-09-05" + D, "keys", False, False),
    ("Receipt 2026-03-15", "2026-03-15", "2026-03-15" + D, "receipt", False, False),
    ("receipt 2026-02-31", None, None, "receipt 2026-02-31", False, False),
]


def sql_text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def golden(columns: str, pick) -> str:
    """Each turn of a conversation asks one of the questions; what is known of that question, by its number."""
    rows = ", ".join(f"({k}, " + ", ".join(pick(c)) + ")" for k, c in enumerate(CASES))
    return f"SELECT c.conv_id, c.turn, {columns} FROM conversations c JOIN (VALUES {rows}) t(k, {columns}) ON (c.conv_id * 7 + c.turn) % {len(CASES)} = t.k"


def ms(s: str | None) -> str:
    return "NULL::BIGINT" if s is None else f"epoch_ms(TIMESTAMP '{s.replace('T', ' ')}')"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations, each with a question (of which there are ``len(CASES)``) and the clock."""
    question = F.get(F.array(*[F.lit(c[0]) for c in CASES]), ((F.col("conv_id") * 7 + F.col("turn")) % len(CASES)).cast("int"))
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", question.alias("query"), F.lit(CLOCK).cast("long").alias("now_ms"))


@query(
    "qt_parse",
    golden("query, embed_text, since_ms, until_ms, recall_intent, time_only", lambda c: (sql_text(c[0]), sql_text(c[3]), ms(c[1]), ms(c[2]), str(c[4]), str(c[5]))),
)
def qt_parse(spark, sf_dir):
    """What a question says: words, window, form (STR-d, STR-e, STR-f, STR-h)."""
    with zone(spark):
        return asked(spark, sf_dir).withColumn("p", T.parse(F.col("query"), F.col("now_ms"))).select("conv_id", "turn", "query", "p.*")


@query("qt_relative_window", golden("query, since_ms", lambda c: (sql_text(c[0]), ms(c[1] if not any(m in c[0].lower() for m in ("august", "sept", "сент", "february", "2026-")) else ("2026-08-16" if "yesterday" in c[0] else None)))))
def qt_relative_window(spark, sf_dir):
    with zone(spark):
        return asked(spark, sf_dir).withColumn("w", T.relative_window(F.col("query"), F.col("now_ms"))).select("conv_id", "turn", "query", "w.since_ms")


@query("qt_absolute_date", golden("query, day", lambda c: (sql_text(c[0]), f"{sql_text(c[1][:10] if c[1] and any(m in c[0].lower() for m in ('august', 'sept', 'сент', 'february', '2026-')) else None)}::DATE")))
def qt_absolute_date(spark, sf_dir):
    with zone(spark):
        return asked(spark, sf_dir).select("conv_id", "turn", "query", T.absolute_day(F.col("query"), F.col("now_ms")).alias("day"))


WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

#: Questions asked at an event's time: the words in SQL, and the window by plain arithmetic on dates; ``d``, ``w`` and ``m`` are the starts of
#: the event's day, week and month, ``i`` its id.
ASKED_AT = [
    ("'keys yesterday'", "d - INTERVAL 1 DAY", "d"),
    ("'mug the day before yesterday'", "d - INTERVAL 2 DAY", "d - INTERVAL 1 DAY"),
    ("'mug last week'", "w - INTERVAL 7 DAY", "w"),
    ("'mug this week'", "w", "NULL"),
    ("'bike last month'", "m - INTERVAL 1 MONTH", "m"),
    ("'bike this month'", "m", "NULL"),
    ("'car ' || (2 + i % 25) || ' days ago'", "d - to_days((2 + i % 25)::INT)", "d - to_days((1 + i % 25)::INT)"),
    ("'car an hour ago'", "asked - INTERVAL 1 HOUR", "NULL"),
    ("'lamp today'", "d", "NULL"),
    ("'last ' || {weekdays}[1 + i % 7]", "d - to_days(((isodow(d) - (1 + i % 7) + 6) % 7 + 1)::INT)", "d - to_days(((isodow(d) - (1 + i % 7) + 6) % 7)::INT)"),
    ("{months}[1 + i % 12] || ' ' || (1 + i % 28)", "day", "day + INTERVAL 1 DAY"),
    ("'receipt ' || strftime(d - to_days((i % 400)::INT), '%Y-%m-%d')", "d - to_days((i % 400)::INT)", "d - to_days((i % 400)::INT) + INTERVAL 1 DAY"),
    ("'boots in ' || {months}[other]", "of_month", "of_month + INTERVAL 1 MONTH"),
]


def asked_at_sql() -> str:
    fill = lambda x: x.replace("{weekdays}", str(WEEKDAYS)).replace("{months}", str(MONTHS))
    pick = lambda j: "CASE i % " + str(len(ASKED_AT)) + " " + " ".join(f"WHEN {k} THEN {fill(c[j])}" for k, c in enumerate(ASKED_AT)) + " END"
    return f"""WITH e AS (SELECT event_id, event_id // {len(ASKED_AT)} AS half, event_id AS i, ts::TIMESTAMP AS asked, date_trunc('day', ts)::TIMESTAMP AS d, date_trunc('week', ts)::TIMESTAMP AS w, date_trunc('month', ts)::TIMESTAMP AS m FROM events),
    f AS (SELECT *, make_date(year(d), 1 + i % 12, 1 + i % 28) AS near, 1 + (month(d) + i % 11) % 12 AS other FROM e),
    g AS (SELECT *, CASE WHEN near <= d::DATE THEN near ELSE make_date(year(d) - 1, 1 + i % 12, 1 + i % 28) END::TIMESTAMP AS day, make_date(CASE WHEN other < month(d) THEN year(d) ELSE year(d) - 1 END, other, 1)::TIMESTAMP AS of_month FROM f)
    SELECT event_id, {pick(0)} AS query, epoch_us({pick(1)}) // 1000 AS since_ms, coalesce(epoch_us({pick(2)}) // 1000 - 1, epoch_us(asked) // 1000) AS until_ms FROM g"""


@query("qt_asked_at", asked_at_sql())
def qt_asked_at(spark, sf_dir):
    """Windows of questions that are asked at each event's own time (DT4-DT7); the SQL has them by arithmetic on dates, without the grammar."""
    with zone(spark):
        i = F.col("event_id")
        day, name = F.col("ts").cast("date"), lambda names, k: F.get(F.array(*map(F.lit, names)), k.cast("int"))
        said = [
            F.lit("keys yesterday"), F.lit("mug the day before yesterday"), F.lit("mug last week"), F.lit("mug this week"), F.lit("bike last month"), F.lit("bike this month"),
            F.concat(F.lit("car "), 2 + i % 25, F.lit(" days ago")), F.lit("car an hour ago"), F.lit("lamp today"), F.concat(F.lit("last "), name(WEEKDAYS, i % 7)),
            F.concat(name(MONTHS, i % 12), F.lit(" "), 1 + i % 28), F.concat(F.lit("receipt "), F.date_format(F.date_sub(day, (i % 400).cast("int")), "yyyy-MM-dd")),
            F.concat(F.lit("boots in "), name(MONTHS, (F.month(day) + i % 11) % 12)),
        ]
        e = M.table(spark, sf_dir, "events").select("event_id", M.epoch_ms(F.col("ts")).alias("now_ms"), F.get(F.array(*said), (i % len(said)).cast("int")).alias("query"))
        return e.withColumn("p", T.parse(F.col("query"), F.col("now_ms"))).select("event_id", "query", "p.since_ms", "p.until_ms")


PHRASE = "trim(regexp_replace(regexp_replace(lower(text), '{q}', ''), '{a}', ''))".format(q=T.QUESTION.replace("'", "''"), a=T.ARTICLE)


@query("qt_search_phrase", f"SELECT conv_id, turn, CASE WHEN {PHRASE} = '' THEN text ELSE {PHRASE} END AS phrase FROM conversations")
def qt_search_phrase(spark, sf_dir):
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.search_phrase(F.col("text")).alias("phrase"))


WORDS = "list_distinct(list_filter(string_split_regex(text, '[^0-9A-Za-z_]+'), lambda t: length(t) > 2))"


@query("qt_tokens", f"SELECT conv_id, turn, list_sort({WORDS}) AS tokens FROM conversations")
def qt_tokens(spark, sf_dir):
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(T.tokens(F.col("text"))).alias("tokens"))


@query(
    "qt_label_match",
    f"""SELECT conv_id, turn, label FROM (SELECT conv_id, turn, {WORDS} AS toks FROM conversations), (SELECT unnest({NAMES}) AS label)
    WHERE len(list_filter(list_filter(string_split(label, ' '), lambda t: length(t) > 2), lambda a: len(list_filter(toks, lambda b: a = b OR (length(a) >= 4 AND contains(b, a)) OR (length(b) >= 4 AND contains(a, b)))) > 0)) > 0""",
)
def qt_label_match(spark, sf_dir):
    """Turns that name a class; the 80 names are one array."""
    c = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("toks"))
    named = F.filter(F.array(*map(F.lit, M.COCO_NAMES)), lambda n: T.label_matches(n, F.col("toks")))
    return c.select("conv_id", "turn", F.explode(named).alias("label"))


@query("qt_recall_intent", "SELECT conv_id, turn, regexp_matches(lower(text), '{}') AS recall FROM conversations".format(T.RECALL.replace("'", "''")))
def qt_recall_intent(spark, sf_dir):
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_recall(F.col("text")).alias("recall"))


@query(
    "qt_tool_args",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'raw' ELSE o_orderpriority END AS phrase, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS label,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN epoch_ms(date_trunc('day', o_orderdate)) WHEN 2 THEN NULL ELSE NULL END AS since_ms,
    CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN epoch_ms(date_trunc('day', o_orderdate) + INTERVAL 1 DAY) - 1 WHEN 2 THEN NULL ELSE NULL END AS until_ms FROM orders""",
)
def qt_tool_args(spark, sf_dir):
    """Arguments of a tool call: blanks and what can't be read count as absent (STR-i)."""
    with zone(spark):
        o, k = M.table(spark, sf_dir, "orders"), F.col("o_orderkey")
        bound = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 2, "soon")
        phrase, label = F.when(k % 3 == 0, "  ").otherwise(F.col("o_orderpriority")), F.when(k % 5 == 0, " ").otherwise(F.col("o_orderstatus"))
        absent = lambda c: F.nullif(F.trim(c), F.lit(""))
        return o.select(
            "o_orderkey", F.coalesce(absent(phrase), F.lit("raw")).alias("phrase"), absent(label).alias("label"),
            T.bound_ms(bound, False).alias("since_ms"), T.bound_ms(bound, True).alias("until_ms"),
        )


# --- small texts of the display


@query(
    "txt_elapsed",
    "SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || ' min ago' ELSE (s // 3600) || ' hrs ago' END AS shown FROM (SELECT event_id, (1706745600000 - epoch_us(ts) // 1000) // 1000 % 90000 AS s FROM events)",
)
def txt_elapsed(spark, sf_dir):
    """STR-m."""
    s = F.expr("(1706745600000 - t) div 1000 % 90000")
    e = M.table(spark, sf_dir, "events").select("event_id", M.epoch_ms(F.col("ts")).alias("t")).select("event_id", s.alias("s"))
    shown = F.when(F.col("s") < 60, F.concat("s", F.lit("s ago"))).when(F.col("s") < 3600, F.concat(F.expr("s div 60"), F.lit(" min ago")))
    return e.select("event_id", shown.otherwise(F.concat(F.expr("s div 3600"), F.lit(" hrs ago"))).alias("shown"))


@query("txt_badge", "SELECT vec_id, CASE WHEN label % 3 = 0 AND label % 2 = 0 THEN 'SAW+HEARD' WHEN label % 3 = 0 THEN 'SAW' ELSE 'HEARD' END AS badge FROM embeddings")
def txt_badge(spark, sf_dir):
    """STR-n."""
    saw, heard = F.col("label") % 3 == 0, F.col("label") % 2 == 0
    return M.table(spark, sf_dir, "embeddings").select("vec_id", F.when(saw & heard, "SAW+HEARD").when(saw, "SAW").otherwise("HEARD").alias("badge"))


@query("txt_percent", with_points("SELECT id, trunc(verify_cos * 100)::INTEGER AS percent FROM points"))
def txt_percent(spark, sf_dir):
    """Truncated towards zero (STR-o)."""
    return M.points(spark, sf_dir).select("id", (F.col("verify_cos") * 100).cast("int").alias("percent"))


@query("txt_bbox_parts", with_points("SELECT id, split_part(bbox, ',', 1)::DOUBLE AS l, split_part(bbox, ',', 2)::DOUBLE AS t, split_part(bbox, ',', 3)::DOUBLE AS r, split_part(bbox, ',', 4)::DOUBLE AS b FROM points WHERE bbox <> ''"))
def txt_bbox_parts(spark, sf_dir):
    """STR-p."""
    p = M.points(spark, sf_dir).filter("bbox <> ''").select("id", F.transform(F.split("bbox", ","), lambda x: x.try_cast("double")).alias("x"))
    return p.select("id", *[F.get("x", F.lit(k)).alias(n) for k, n in enumerate("ltrb")])


@query(
    "txt_prompt",
    with_points(
        """, h AS (SELECT episode_id, label, timestamp_ms, id, row_number() OVER (PARTITION BY episode_id ORDER BY timestamp_ms, id) AS k, count(*) OVER (PARTITION BY episode_id) AS n FROM points WHERE type = 'region'),
        l AS (SELECT episode_id, max(n) AS n, string_agg('- ' || CASE WHEN label = '' THEN 'a moment' ELSE label END || ' (' || strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M') || ')', chr(10) ORDER BY k) AS lines FROM h WHERE k <= 8 GROUP BY episode_id),
        e AS (SELECT DISTINCT user_id AS episode_id FROM events)
        SELECT episode_id, CASE WHEN lines IS NULL THEN 'The user asked: "what was here". Nothing was found in their memory for this — tell them so, briefly.'
          ELSE 'The user asked: "what was here".' || chr(10) || 'Here are ' || n || ' moment(s) from their visual memory:' || chr(10) || lines || chr(10) || 'Answer their question conversationally, grounded in these moments.' END AS prompt,
          CASE WHEN lines IS NULL THEN 'Ничего не нашёл.' ELSE 'Нашёл ' || n || '.' END AS stub
        FROM e LEFT JOIN l USING (episode_id)"""
    ),
)
def txt_prompt(spark, sf_dir):
    """What the answering model is told about the first eight hits, and the answer without one (STR-q, STR-r)."""
    from pyspark.sql import Window

    with zone(spark):
        w = Window.partitionBy("episode_id").orderBy("timestamp_ms", "id")
        h = M.points(spark, sf_dir).filter("type = 'region'").select("episode_id", "id", "timestamp_ms", "label")
        counts = h.groupBy("episode_id").agg(F.count("*").alias("n"))
        line = F.concat(F.lit("- "), F.coalesce(F.nullif("label", F.lit("")), F.lit("a moment")), F.lit(" ("), F.date_format(F.timestamp_millis("timestamp_ms"), "yyyy-MM-dd HH:mm"), F.lit(")"))
        first = h.withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("s")))).alias("l"))
        lines = first.join(counts, "episode_id").select("episode_id", "n", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("lines"))
        e = M.table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id")).distinct().join(lines, "episode_id", "left")
        told = F.concat(
            F.lit('The user asked: "what was here".\nHere are '), F.col("n").cast("string"), F.lit(" moment(s) from their visual memory:\n"), "lines",
            F.lit("\nAnswer their question conversationally, grounded in these moments."),
        )
        nothing = F.lit('The user asked: "what was here". Nothing was found in their memory for this — tell them so, briefly.')
        stub = F.when(F.col("lines").isNull(), "Ничего не нашёл.").otherwise(F.concat(F.lit("Нашёл "), F.col("n").cast("string"), F.lit(".")))
        return e.select("episode_id", F.coalesce(told, nothing).alias("prompt"), stub.alias("stub"))


@query("txt_stt_result", "SELECT conv_id, CASE WHEN final <> '' THEN final ELSE partial END AS said FROM (SELECT conv_id, max(CASE WHEN turn = last AND turn % 2 = 0 THEN trim(text) ELSE '' END) AS final, arg_max(trim(text), turn) FILTER (trim(text) <> '') AS partial FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) GROUP BY conv_id)")
def txt_stt_result(spark, sf_dir):
    """The final text, or else the last partial one that isn't blank (STR-s)."""
    c = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("text"))
    last = c.groupBy("conv_id").agg(F.max_by("text", "turn").alias("t"), F.max("turn").alias("k"), F.max_by(F.nullif("text", F.lit("")), F.when(F.col("text") != "", F.col("turn"))).alias("partial"))
    final = F.nullif(F.when(F.col("k") % 2 == 0, F.col("t")), F.lit(""))
    return last.select("conv_id", F.coalesce(final, "partial").alias("said"))


@query("txt_stt_json", """SELECT conv_id, turn, CASE WHEN contains(text, '"') THEN trim(split_part(text, '"', 1)) ELSE trim(text) END AS said, '' AS missing FROM conversations""")
def txt_stt_json(spark, sf_dir):
    """A field of a recogniser's JSON by pattern (STR-t)."""
    c = M.table(spark, sf_dir, "conversations")
    j = F.concat(F.lit('{"text" : "'), "text", F.lit('"}'))
    return c.select("conv_id", "turn", F.trim(F.regexp_extract(j, '"text"\\s*:\\s*"([^"]*)"', 1)).alias("said"), F.regexp_extract(j, '"partial"\\s*:\\s*"([^"]*)"', 1).alias("missing"))


@query("txt_setting", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN p_name ELSE ' ' END, ' '), nullif(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, ''), '') AS value FROM part")
def txt_setting(spark, sf_dir):
    """The first of two settings that isn't blank (STR-u)."""
    size, given = F.col("p_size"), lambda c: F.when(F.trim(c) != "", c)
    debug, kept = F.when(size % 3 == 0, F.col("p_name")).otherwise(" "), F.when(size % 2 == 0, F.col("p_brand")).otherwise("")
    return M.table(spark, sf_dir, "part").select("p_partkey", F.coalesce(given(debug), given(kept), F.lit("")).alias("value"))


@query("dt_shown", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M') AS card, epoch_us(date_trunc('day', ts)) // 1000 AS day_ms, epoch_us(date_trunc('week', ts)) // 1000 AS week_ms, epoch_us(date_trunc('month', ts)) // 1000 AS month_ms, epoch_us(ts) // 1000 + event_id * 1000 // 16000 AS sample_ms FROM events")
def dt_shown(spark, sf_dir):
    """Times as shown, and the starts of their day, week and month (DT1-DT3, DT8, DT9)."""
    with zone(spark):
        e = M.table(spark, sf_dir, "events").select("event_id", "ts", M.epoch_ms(F.col("ts")).alias("t"))
        day = T.instant(F.col("t")).cast("date")
        return e.select(
            "event_id", F.date_format("ts", "HH:mm:ss").alias("clock"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("card"), T.start_of(day).alias("day_ms"),
            T.start_of(F.trunc(day, "week").cast("date")).alias("week_ms"), T.start_of(F.trunc(day, "month").cast("date")).alias("month_ms"), (F.col("t") + F.expr("event_id * 1000 div 16000")).alias("sample_ms"),
        )


@query("dt_days", "SELECT event_id, epoch_us(date_trunc('day', ts) - INTERVAL 1 DAY) // 1000 AS previous_ms, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) // 1000 AS next_ms FROM events")
def dt_days(spark, sf_dir):
    """The starts of the day before and of the day after (DT2)."""
    with zone(spark):
        day = F.col("ts").cast("date")
        return M.table(spark, sf_dir, "events").select("event_id", T.start_of(F.date_sub(day, 1)).alias("previous_ms"), T.start_of(F.date_add(day, 1)).alias("next_ms"))


def clip_vocabulary(path: str | None = None):
    """Vocabulary and merges of the public tokenizer whose frame ids the encoder has; a small one where it isn't installed."""
    if path is None and importlib.util.find_spec("public_tokenizers") is not None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return tokenizers.load_bpe(path) if path else tokenizers.toy_bpe()


def wordpiece_vocabulary() -> dict[str, int]:
    """Pieces of words by a rule from the public vocabulary: its tokens at a word's beginning, and after it; a small one where it isn't installed.

    Nothing is trained: each token without its mark of a word's end is a piece of either kind.
    """
    tokens = sorted({t.removesuffix("</w>") for t in clip_vocabulary()[0]} - {""})
    return {piece: tokenizers.SEP + 1 + k for k, piece in enumerate([*tokens, *("##" + t for t in tokens)])}


@query("tok_ranked_bpe")
def tok_ranked_bpe(spark, sf_dir):
    """Ids of ranked BPE (STR-j)."""
    c = M.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tokenizers.ranked_bpe(F.col("text"), *clip_vocabulary()).alias("ids"))


@query("tok_plain_bpe")
def tok_plain_bpe(spark, sf_dir):
    """Ids of the simpler BPE that the ranked one is compared with (STR-k)."""
    c = M.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tokenizers.plain_bpe(F.col("text"), *clip_vocabulary()).alias("ids"))


@query("tok_wordpiece")
def tok_wordpiece(spark, sf_dir):
    """Ids of WordPiece with the pieces of the public vocabulary (STR-l)."""
    c = M.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tokenizers.wordpiece(F.col("text"), wordpiece_vocabulary()).alias("ids"))
