"""The registered queries of the training-data operators: thin views of what the operators return."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from . import language_model
from .common import text_table
from .divergence import source_divergence
from .licences import END, HINT, MARK, compiled, scan_licences, stretches
from .media import media_columns
from .mixing import mix
from .neardup import MinHashParams, document_components, repeated_paragraphs
from .neighbours import nearest, usable
from .packing import packed_documents
from .passages import repeated_passages
from .periodic import periodic_runs
from .quality import held_out, quality_model, scored
from .sentencepieces import encode_documents
from .token_files import read_token_files, write_token_files

QUERIES = {}
ORACLE = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_minhash_near_dedup(spark, sf_dir):
    """Components of documents whose 4-word shingle sets reach similarity 0.8."""
    return document_components(text_table(spark, sf_dir), MinHashParams(shingle=4))


@query
def op6_paragraph_dedup(spark, sf_dir):
    """Stretches of 50 words or more that occur elsewhere too, wherever lines end: paragraphs with near copies (5-word shingles, similarity 0.8), grown."""
    return repeated_passages(text_table(spark, sf_dir))


@query
def op6_long_lines(spark, sf_dir):
    """The same banding over whole lines of 50 words or more that have a near copy anywhere."""
    return repeated_paragraphs(text_table(spark, sf_dir))


@query
def op1_pitman_yor(spark, sf_dir):
    """Log10 probability of every document under the language model and under add-one unigrams."""
    return language_model.score(language_model.fit(text_table(spark, sf_dir), language_model.every_seventh(), language_model.ModelParams(own=True)))


@query
def op2_inverted_multi_index(spark, sf_dir):
    """The 10 nearest vectors of every vector whose id is divisible by 100."""
    vectors = usable(text_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(vectors, vectors.where("id % 100 = 0"), 10)


@query
def op3_licence_scan(spark, sf_dir):
    """Known licence sentences of every document, in order, and the licences that their sequence makes."""
    found = scan_licences(text_table(spark, sf_dir))
    joined = {c: F.array_join(c, " ") for c in ("sentence_ids", "licences")}
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.size("licences").cast("long").alias("n_licences"), *[v.alias(k) for k, v in joined.items()])


@query
def op4_source_mix(spark, sf_dir):
    """The part of each document in a mix with source weights 1, 2, 3, 1, 2, ..."""
    return mix(text_table(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op7_sentencepiece(spark, sf_dir):
    """Ids of every document by a prefix table, and what they decode to."""
    return encode_documents(text_table(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_quality_votes(spark, sf_dir):
    """Quality of every document by the votes of its nearest labelled texts."""
    docs = text_table(spark, sf_dir)
    model = quality_model(docs, text_table(spark, sf_dir, "labels"))
    return scored(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


@query
def op9_token_files(spark, sf_dir):
    """Ids of every document, written to flat files in doc_id order and read back."""
    shards = write_token_files(text_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, fold=True)
    return read_token_files(shards)


@query
def op10_media_columns(spark, sf_dir):
    """Every document as an image in a tar shard, and what its stored bytes say."""
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return media_columns(text_table(spark, sf_dir)).select(*columns, "width", "height")


@query
def op11_source_divergence(spark, sf_dir):
    """How far the sources of a language are from each other, and the terms that set each apart from its language."""
    return source_divergence(text_table(spark, sf_dir))


def folded(keys, offsets) -> np.ndarray | None:
    """The places of the words that stand in each text once a tenth of the texts, by the crc32 of their ids, repeat themselves from some word on. A null id changes nothing."""
    order = None
    for i, doc_id in enumerate(keys[0].to_pylist()):
        h, n = zlib.crc32(str(doc_id).encode()), int(offsets[i + 1] - offsets[i])
        if doc_id is None or h % 10 or not n:
            continue
        order = np.arange(int(offsets[-1])) if order is None else order
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[offsets[i] + a : offsets[i + 1]] = offsets[i] + a + np.arange(n - a) % p
    return order


@query
def op12_periodic_runs(spark, sf_dir):
    """Runs of 24 words or more and three periods or more of every document, a tenth of which are made to repeat themselves."""
    found = periodic_runs(text_table(spark, sf_dir), ["doc_id"], reorder=folded)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


@query
def op13_best_fit_packing(spark, sf_dir):
    """Every document's ids in sequences of at most 2,048."""
    return packed_documents(text_table(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048, fold=True)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _components_sql(items: str, shingle: int, key: str) -> str:
    """``items``: SELECT id, w (list of words). CTEs up to comp(id, root) of near copies at similarity 0.8."""
    return rf"""
    WITH RECURSIVE items AS MATERIALIZED ({items}),
    sh AS MATERIALIZED (
      SELECT DISTINCT id, CASE WHEN len(w) >= {shingle} THEN array_to_string(w[i:i+{shingle - 1}], ' ') ELSE array_to_string(w, ' ') END AS s
      FROM (SELECT id, w, unnest(range(1, greatest(len(w) - {shingle - 2}, 2))) AS i FROM items WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT id, count(*) AS n FROM sh GROUP BY id),
    links AS MATERIALIZED (
      SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2) p
      JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b WHERE 100 * p.k >= 80 * (na.n + nb.n - p.k)),
    reach AS (
      SELECT id, id AS root FROM items
      UNION
      SELECT e.y, r.root FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links) e ON e.x = r.id),
    comp AS (SELECT id, min(root) AS root, count(*) AS size FROM reach GROUP BY id)
    """


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

ORACLE["op5_minhash_near_dedup"] = (
    _components_sql(f"SELECT doc_id AS id, {_WORDS} AS w FROM documents", 4, "doc_id")
    + """
    SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, c.id = c.root AS kept
    FROM comp c LEFT JOIN n ON n.id = c.id"""
)

ORACLE["op6_long_lines"] = (
    _components_sql(
        f"""SELECT {{'d': doc_id, 'p': CAST(p AS BIGINT)}} AS id, w FROM (
              SELECT doc_id, i - 1 AS p, {_WORDS.replace("coalesce(text, '')", 'lines[i]')} AS w
              FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))
            WHERE len(w) >= 50""",
        5,
        "id",
    )
    + """
    SELECT c.id.d AS doc_id, c.id.p AS part, CAST(len(i.w) AS BIGINT) AS n_words, c.root.d AS component_doc_id, c.root.p AS component_part,
           c.size AS component_size, c.id = c.root AS kept
    FROM comp c JOIN items i ON i.id = c.id WHERE c.size > 1"""
)

ORACLE["op4_source_mix"] = r"""
    WITH RECURSIVE d AS MATERIALIZED (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
      FROM documents),
    s AS MATERIALIZED (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w
      FROM d GROUP BY source),
    total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS t FROM s),
    -- reshare what stopped sources leave, until none is above
    share AS (
      SELECT 0 AS step, t / (SELECT sum(w) FROM s) AS level FROM total
      UNION ALL
      SELECT step + 1, (SELECT (max(total.t) - coalesce(sum(s.source_size * 3) FILTER (WHERE level * s.w > s.source_size * 3), 0))
                        / sum(s.w) FILTER (WHERE level * s.w <= s.source_size * 3) FROM s, total)
      FROM share WHERE step < 60),
    last AS (SELECT level FROM share ORDER BY step DESC LIMIT 1),
    b AS MATERIALIZED (
      SELECT source, source_size,
             CASE WHEN level * w > source_size * 3 THEN CAST(source_size * 3 AS DOUBLE) ELSE level * w END AS target
      FROM s, last),
    p AS (
      SELECT d.*, b.source_size, b.target, CAST(floor(b.target + 0.5) AS BIGINT) AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, size, source_size, target, source,
           CAST(CASE WHEN source_size = 0 THEN 0
                ELSE (budget // source_size) * size + least(greatest(budget % source_size - before, 0), size) END AS BIGINT) AS taken
    FROM p"""


def _licence_sql() -> str:
    known, rules = compiled()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = "MAP {" + ", ".join(f"{quoted(k)}: '{v}'" for k, v in known.items()) + "}"
    look = "(SELECT m FROM known)[trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))]"
    rest, steps = "r0", []
    for i, (licence, own) in enumerate(rules):
        key = "".join(f"<{x}>" for x in own)
        steps.append(f"r{i + 1} AS (SELECT doc_id, ids, list_concat(l, list_transform(range(len(string_split(rest, '{key}')) - 1), lambda x: '{licence}')) AS l, replace(rest, '{key}', '|') AS rest FROM r{i})")
    return rf"""
    WITH known AS (SELECT {table} AS m),
    cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{END}', '\1{MARK}', 'g'), '{MARK}') AS s FROM documents),
    one AS (SELECT doc_id, s, generate_subscripts(s, 1) AS i FROM cut),
    unit AS (SELECT doc_id, i, s[i] AS s, {look.format("s[i]")} AS whole FROM one WHERE regexp_matches(s[i], '{HINT}')),
    line AS (SELECT doc_id, i, 0 AS j, whole AS id FROM unit WHERE whole IS NOT NULL
             UNION ALL
             SELECT doc_id, i, j, (SELECT m FROM known)[replace(x[j], chr(10) || chr(10), ' ')] FROM (SELECT *, generate_subscripts(x, 1) AS j FROM (SELECT doc_id, i, regexp_extract_all(
               trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9\n]+', ' ', 'g'), ' ?\n[ \n]*', chr(10) || chr(10), 'g'), ' ' || chr(10)), '{stretches(known)}', 1) AS x FROM unit WHERE whole IS NULL AND contains(s, chr(10))))),
    ids AS (SELECT doc_id, list(id ORDER BY i, j) AS ids FROM line WHERE id IS NOT NULL GROUP BY doc_id),
    r0 AS (SELECT d.doc_id, coalesce(ids, []) AS ids, CAST([] AS VARCHAR[]) AS l,
                  coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest FROM documents d LEFT JOIN ids USING (doc_id)),
    {", ".join(steps)}
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, CAST(len(l) AS BIGINT) AS n_licences,
           coalesce(array_to_string(ids, ' '), '') AS sentence_ids, coalesce(array_to_string(list_sort(l), ' '), '') AS licences
    FROM r{len(rules)}"""


ORACLE["op3_licence_scan"] = _licence_sql()


ORACLE["op11_source_divergence"] = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                                   translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
    o AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    c AS MATERIALIZED (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY ALL),
    t AS MATERIALIZED (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
    p AS MATERIALIZED (
      SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(t.total, 0) + 2 * l.v) AS p,
             1 + (1000000000 * (kept.n + 2)::HUGEINT) // (l.total + 2 * l.v) AS q
      FROM g JOIN kept ON kept.lang = g.lang JOIN l ON l.lang = g.lang
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
    WHERE part = 'pair' OR rank <= 10"""
