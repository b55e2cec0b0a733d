"""The thin opN queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, lines, middles, mixing, packing, quality, rabitq, simhash, tiff, tokenfiles, urls, variants, warc
from .common import stash, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


@query(
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
    c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    j AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM j GROUP BY doc_id"""
)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2.0::DOUBLE * source_size AS most FROM p),
    v AS (SELECT *, ((1.5::DOUBLE * sum(source_size) OVER ()) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
          FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM v),
    s AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS words,
                 CAST(sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR) || '|mix'), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(greatest(0, least(start + size, words) - least(start, words)) + greatest(0, least(start + source_size + size, words) - least(start + source_size, words)) AS BIGINT) AS taken
    FROM s"""
)
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.json_bpe).drop("ids")


#: Of a sequence of conversations: a quarter of its tokens at least is no answer.
CONVERSATIONS = packing.Limits(tokens=4096, segments=32, loss=3072)


@query()
def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector bin packing as it is meant: whole conversations under three limits that all bind."""
    examples = stash(packing.instruction_examples(table(spark, sf_dir, "conversations"), packing.json_bpe), "examples")
    placed = packing.pack_examples(examples, CONVERSATIONS, alone=True)
    return examples.join(placed, "example_id").withColumnRenamed("example_id", "conv_id")


@query(
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    c(s, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.s, p.b FROM c JOIN p ON c.r = p.a),
    m AS (SELECT s AS vec_id, min(r) AS component_id FROM c GROUP BY s)
    SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m"""
)
def op9_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = tiff.text_media(table(spark, sf_dir, "documents"))
    media = media.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    return tiff.page_digests(tiff.tiff_pages(media, "media"))


@query(
    """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
    h AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS hex FROM p),
    d AS (SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY hex) AS last_id,
                 list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
                   ((instr('0123456789ABCDEF', substr(hex || '0', 1 + (5 * i) // 4, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(hex || '0', 2 + (5 * i) // 4, 1)) - 1)
                   >> CAST(3 - (5 * i) % 4 AS INTEGER)) % 32 AS INTEGER), 1)), 'string_agg', '') AS payload_digest FROM h)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to FROM d"""
)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


@query()
def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


@query()
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
    h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(hex, 1 + 8 * k, 8) AS BIGINT)) AS h FROM d),
    c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                      WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                  ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
)
def op11_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middles.restore_text(middles.fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query(
    r"""
    WITH RECURSIVE
    rule AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])),
               lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS step),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
             FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL),
    coded AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, CAST(octet_length(encode(doc || ':' || run)) AS BIGINT) + 1),
                lambda i: CAST('0x' || substr(hex(encode(doc || ':' || run)), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT))),
                lambda a, b: xor(a // 256, step[1 + xor(a % 256, b)])), 4294967295) AS h FROM runs, rule),
    typed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM coded),
    w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w),
    holes AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM places),
    near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
             UNION ALL SELECT w.word, w.n, h.word, h.n FROM w JOIN (SELECT DISTINCT word, n, rest FROM holes) h ON h.rest = w.word
             UNION ALL SELECT h.word, h.n, w.word, w.n FROM w JOIN (SELECT DISTINCT word, n, rest FROM holes) h ON h.rest = w.word),
    best AS (SELECT word, count(*) AS n_near, min({'o': -other_n, 'word': other}) AS b FROM near GROUP BY word),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.o >= 2 * w.n THEN b.word END AS form, CASE WHEN -b.o >= 2 * w.n THEN -b.o END AS form_n FROM w LEFT JOIN best USING (word)),
    walk(word, here) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NOT NULL),
    root AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = walk.here WHERE f.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)"""
)
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"), typo_every=97)


@query()
def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.store_ids(table(spark, sf_dir, "documents"), tokenfiles.word_bpe)
