"""Queries over sets of documents, conversations, pages and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..streaming import events as E
from .registry import query, table


@query("SELECT sha256(text) AS sha256, count(*) AS n_copies, min(doc_id) AS first FROM documents GROUP BY 1")
def doc_dedupe(spark, sf_dir):
    return D.content_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""
SELECT conv_id * 1000 + turn AS doc_id, CAST(1 AS INT) AS line, CAST(turn + 1 AS VARCHAR) || '.' || CAST(turn % 3 + 1 AS VARCHAR) AS number, role || ' part' AS title, CAST(2 AS INT) AS level FROM conversations
UNION ALL SELECT conv_id * 1000 + turn, CAST(2 AS INT), CAST(turn + 1 AS VARCHAR) || '.' || CAST(turn % 3 + 1 AS VARCHAR) || '.1', 'Scope', CAST(3 AS INT) FROM conversations""")
def doc_outline(spark, sf_dir):
    """Numbered headings of texts made of the turns of conversations."""
    number = F.concat((F.col("turn") + 1).cast("string"), F.lit("."), (F.col("turn") % 3 + 1).cast("string"))
    body = F.concat(F.lit("x"), F.translate("text", "\n", " "), F.lit("\n"), number, F.lit(" "), F.col("role"), F.lit(" part\n  "), number, F.lit(".1. Scope"))
    docs = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), body.alias("text"))
    return D.outline(docs, "doc_id", "text")


_REF = r"[0-9]{3}[-. ][0-9]{4}"


@query(f"SELECT doc_id, upper(regexp_replace(raw, '[-_. ]', '', 'g')) AS code, count(*) AS n, min(raw) AS shown FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_REF}')) AS raw FROM documents) GROUP BY 1, 2")
def doc_refs(spark, sf_dir):
    """Codes that documents mention, in whatever spelling."""
    return D.mentions(table(spark, sf_dir, "documents"), "doc_id", "text", pattern=_REF)


@query("""
WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages)
SELECT host, count(*) AS n_links, count(DISTINCT target) AS n_targets, count(*) FILTER (target NOT IN (SELECT url FROM pages)) AS n_missing FROM l GROUP BY host""")
def doc_orphans(spark, sf_dir):
    """Links of pages by host, and how many lead to no page that there is."""
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("target"))
    known = pages.select(F.col("url").alias("target"), F.lit(True).alias("known")).distinct()
    return links.join(known, "target", "left").groupBy("host").agg(F.count("*").alias("n_links"), F.countDistinct("target").alias("n_targets"), F.count_if(F.col("known").isNull()).alias("n_missing"))


_NAME = "printf('PR.%03d-Procedure-R%d&%02d.%02d.%d', CAST(o_custkey % 200 AS INT), CAST(o_orderkey % 12 AS INT), CAST(day(o_orderdate) AS INT), CAST(month(o_orderdate) AS INT), CAST(year(o_orderdate) AS INT))"


def _names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.format_string("PR.%03d-Procedure-R%d&%02d.%02d.%d", F.col("o_custkey") % 200, F.col("o_orderkey") % 12, F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    return o.select("o_orderkey", name.alias("name"))


@query(f"SELECT o_orderkey, {_NAME} AS name, printf('PR%03d', CAST(o_custkey % 200 AS INT)) AS code, 'PR' AS prefix, CAST(o_orderkey % 12 AS INT) AS revision, strftime(o_orderdate, '%Y-%m-%d') AS date, 'EN' AS language FROM orders")
def doc_identity(spark, sf_dir):
    return _names(spark, sf_dir).withColumn("i", D.identity(F.col("name"))).select("o_orderkey", "name", "i.*").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""
WITH d AS (SELECT o_orderkey, printf('PR%03d', CAST(o_custkey % 200 AS INT)) AS code, CAST(o_orderkey % 12 AS INT) AS revision, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders)
SELECT code, revision, date, o_orderkey, n_revisions FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC, revision DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY code) AS n_revisions FROM d) WHERE k = 1""")
def current_revision(spark, sf_dir):
    part = D.identity_parts(F.col("name"))
    docs = _names(spark, sf_dir).select("o_orderkey", part["code"].alias("code"), part["revision"].alias("revision"), F.date_format(part["date"], "yyyy-MM-dd").alias("date"))
    return D.current(docs, "code", [F.desc("date"), F.desc("revision"), F.col("o_orderkey")])


_TR = "(" + " + ".join(f"CAST(contains(n, '{h}') AS INT)" for h in D.TR_HINTS) + ")"
_EN = "(" + " + ".join(f"CAST(regexp_matches(n, '(^|[^a-zçğıöşü]){h}([^a-zçğıöşü]|$)') OR {str(len(h) >= 7).lower()} AND contains(n, '{h}') AS INT)" for h in D.EN_HINTS) + ")"


@query(f"""WITH d AS (SELECT doc_id, lang, coalesce(source, '') || ' ' || coalesce(text, '') AS name FROM documents), c AS (SELECT *, lower(name) AS n FROM d)
SELECT doc_id, lang, CASE WHEN regexp_matches(upper(name), 'TR-EN|TR/EN|EN-TR') THEN 'BOTH' WHEN {_TR} > {_EN} THEN 'TR' WHEN {_EN} > {_TR} THEN 'EN' ELSE 'UNKNOWN' END AS hint FROM c""")
def lang_hints(spark, sf_dir):
    """Language hints in the source and the whole text of every document."""
    name = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", D.language(name).alias("hint"))


@query(r"""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'PR' WHEN 1 THEN 'TL' WHEN 2 THEN 'QM' WHEN 3 THEN 'DD' WHEN 4 THEN 'SD' ELSE 'XX' END AS prefix, o_orderpriority AS p FROM orders)
SELECT o_orderkey, prefix, CASE prefix WHEN 'PR' THEN 'PROCEDURE' WHEN 'TL' THEN 'INSTRUCTION' WHEN 'QM' THEN 'MANUAL' WHEN 'XX' THEN 'OTHER' ELSE CASE WHEN p LIKE '1%' THEN 'POLICY' ELSE 'SUPPORT_DOC' END END AS family,
  prefix || ' 007 ' || CASE WHEN p LIKE '1%' THEN 'policy ' ELSE '' END || p AS name, trim(regexp_replace(CASE WHEN p LIKE '1%' THEN 'policy ' ELSE '' END || p, '[-\s._&()\[\]]+', ' ', 'g'), ' .-_') AS title FROM o""")
def doc_families(spark, sf_dir):
    """Family and title of document names."""
    k = F.col("o_orderkey") % 6
    prefix = F.get(F.array(*map(F.lit, ("PR", "TL", "QM", "DD", "SD", "XX"))), k.cast("int"))
    kind = F.concat(F.when(F.col("o_orderpriority").startswith("1"), "policy ").otherwise(""), F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", prefix.alias("prefix"), F.concat(prefix, F.lit(" 007 "), kind).alias("name"))
    title = D.clean_title(F.col("name"), F.concat(F.col("prefix"), F.lit(".007")), F.lit(None).cast("string"))
    return o.withColumn("title", title).withColumn("family", D.family(F.col("prefix"), F.lower("title")))


@query("""SELECT c_custkey, 'Dear ' || c_name || ', {{ unknown }}: ' || c_mktsegment || ' $1' AS filled, 2 AS n_filled, 'unknown' AS unfilled FROM customer""")
def template_fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("t", F.lit("Dear {{name}}, {{ unknown }}: {{ segment }} $1"))
    out = D.fill(c, "t", {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return out.select("c_custkey", "filled", "n_filled", F.array_join("unfilled", ",").alias("unfilled"))


def _runs(spark, sf_dir):
    kind = F.when(F.col("role") == "user", "ins").when(F.col("turn") % 3 == 2, "del")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), F.col("text"), "role")


_RUNS = "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'ins' WHEN turn % 3 = 2 THEN 'del' END AS kind, text, role FROM conversations"


@query(f"SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) FILTER (kind IS NOT NULL) AS n_resolved FROM ({_RUNS}) WHERE kind IS DISTINCT FROM 'del' GROUP BY 1")
def revisions_accept(spark, sf_dir):
    """Conversations read as paragraphs whose turns are kept, inserted or deleted; all changes accepted."""
    return D.resolve(_runs(spark, sf_dir), True, ["conv_id"], "turn")


@query(f"SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) FILTER (kind IS NOT NULL) AS n_resolved FROM ({_RUNS}) WHERE kind IS DISTINCT FROM 'ins' GROUP BY 1")
def revisions_reject(spark, sf_dir):
    return D.resolve(_runs(spark, sf_dir), False, ["conv_id"], "turn")


@query("""
WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, event_type, min(event_id) AS first, string_agg(CAST(event_id % 10 AS VARCHAR), '' ORDER BY event_id) AS text, count(*) AS n_runs FROM r GROUP BY user_id, run, event_type""")
def merge_equal_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 10).cast("string").alias("text"))
    return D.merge_runs(e, ["user_id"], "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)")
def package_dangling(spark, sf_dir):
    """References whose target is not defined."""
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return D.dangling(refs, table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"])


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def windowed_events(spark, sf_dir):
    out = E.tumbling(table(spark, sf_dir, "events"), "ts", ["event_type"], "6 hours", "value")
    return out.withColumns({"total": F.round("total", 4), "window_start": F.col("window_start").cast("timestamp_ntz"), "window_end": F.col("window_end").cast("timestamp_ntz")})


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n FROM r GROUP BY user_id, k""")
def session_events(spark, sf_dir):
    out = E.sessions(table(spark, sf_dir, "events"), "ts", ["user_id"], "12 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def dedupe_events(spark, sf_dir):
    """The first of each user's events of a kind, as if the others were sent again."""
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return E.once(e.select("user_id", "event_type", "ts", "event_id", "at"), "at", ["user_id", "event_type"]).drop("at")
