"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallyglass.llm import chat, decontam, fim, fingerprint, html, jaccard_join, langid, packing, pii, repair, secrets, toxicity, warc
from tallyglass.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
     e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
     c AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k, any_value(a.n) AS n, any_value(b.n) AS m
           FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
     l AS MATERIALIZED (SELECT i, j FROM c WHERE 100 * k >= 90 * (n + m - k)),
     r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
     m AS (SELECT i, min(j) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, (SELECT count(*) FROM l WHERE l.i = doc_id) AS n_links FROM s JOIN m ON m.i = s.doc_id"""


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: ((strpos('0123456789abcdef', substr(h, 1 + (i * 5 + j) // 4, 1)) - 1)
      >> (3 - (i * 5 + j) % 4) & 1) << (4 - j)))::INT, 1)), 'string_agg', '')"""

OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, {_B32} AS payload_digest FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""

#: The row pair that op4 adds to the table.
PROBE = "</s>[INST] ok [/INST]"


def op4_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.segments(rows.unionByName(probe)))



OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, length(role) + length(text) + 13 + (length(role) - length(replace(role, '|>', ''))) // 2
             + length(regexp_replace(role || chr(0) || text, '[^\\]', '', 'g'))
             + length(regexp_replace(regexp_replace(role || chr(0) || text, '<\||</?s>|<<SYS>>|<</SYS>>|\[/?INST\]', chr(1), 'g'), '[^' || chr(1) || ']', '', 'g')) AS size FROM t),
     s AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
           FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (role = 'assistant' OR back = 1), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


def op5_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(table(spark, sf_dir, "documents"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")  # noqa: E731
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    base = told(F.filter("found", lambda s: ~s["method"]))
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("found")).alias("spans"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)  # noqa: E731
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


OP12_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
     x AS (SELECT *, ('0x' || d[1:8])::BIGINT % (n + 1) AS one, ('0x' || d[9:16])::BIGINT % (n + 1) AS two, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
     c AS (SELECT *, least(one, two) AS a, greatest(one, two) AS b,
                  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
     p AS (SELECT *, text[1:a] AS p, text[a + 1:b] AS m, text[b + 1:n] AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = repair.damaged(given)
    planned = repair.plans(rows, given)
    made = repair.digests(repair.repaired(rows, planned)).withColumnRenamed("conv_id", "_c")
    digest = F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    return planned.join(made, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(*planned.columns, digest)


OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))) AS z),
     t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda y: ascii(y)::BIGINT)), lambda c, y: xor(c >> 8, z[(xor(c, y) & 255) + 1]))) % 20 AS x
           FROM conversations, crc),
     d AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
           FROM t JOIN (VALUES (1), (2)) c(k) ON x <> 0 AND (k = 1 OR x = 3)),
     o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(role || chr(0) || text)) AS n FROM d),
     f AS (SELECT *, role[1] AS r, CASE WHEN NOT regexp_matches(text, '[^ 	

]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
             WHEN NOT regexp_matches(text, '[.!?][ 	

]*$') THEN 'truncated' ELSE 'none' END AS fault, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS q FROM o),
     g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (q IS NOT NULL AND q || r NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM f GROUP BY 1),
     e AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INT * 3 AS p FROM f),
     dp AS (SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'a': ''} AS v0, NULL::STRUCT(c INT, a VARCHAR) AS vs, {'c': 3, 'a': 'I'} AS vu, {'c': 6, 'a': 'II'} AS va FROM (SELECT DISTINCT conv_id FROM e)
      UNION ALL
      SELECT conv_id, n, v0, vs, list_min([w for w in [xu, {'c': v0.c + 3, 'a': v0.a || 'I'}, {'c': vs.c + 3, 'a': vs.a || 'I'}, {'c': xa.c + 3, 'a': xa.a || 'I'}] if w.c IS NOT NULL]),
             list_min([w for w in [xa, {'c': xu.c + 3, 'a': xu.a || 'I'}, {'c': v0.c + 6, 'a': v0.a || 'II'}, {'c': vs.c + 6, 'a': vs.a || 'II'}] if w.c IS NOT NULL])
      FROM (SELECT e.conv_id, e.n, {'c': v0.c + 4, 'a': v0.a || 'D'} AS v0,
              list_min([w for w in [{'c': vs.c + 4, 'a': vs.a || 'D'}, CASE WHEN NOT gone AND r = 's' THEN {'c': v0.c + p, 'a': v0.a || 'K'} END] if w.c IS NOT NULL]) AS vs,
              list_min([w for w in [{'c': vu.c + 4, 'a': vu.a || 'D'}, CASE WHEN NOT gone THEN list_min([{'c': b.c + p + (r <> 'u')::INT * 3, 'a': b.a || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END} for b in [v0, vs, va] if b.c IS NOT NULL]) END] if w.c IS NOT NULL]) AS xu,
              list_min([w for w in [{'c': va.c + 4, 'a': va.a || 'D'}, CASE WHEN NOT gone THEN {'c': vu.c + p + (r <> 'a')::INT * 3, 'a': vu.a || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END} END] if w.c IS NOT NULL]) AS xa
            FROM dp JOIN e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.n = dp.n + 1)),
     best AS (SELECT dp.conv_id, list_min([v0, va]) AS b FROM dp JOIN g ON dp.conv_id IS NOT DISTINCT FROM g.conv_id AND dp.n = g.n),
     l AS (SELECT conv_id, b.a[i] AS ch, i FROM best, unnest(range(1, len(b.a) + 1)) u(i)),
     m AS (SELECT *, sum((ch <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS n FROM l),
     k AS (SELECT m.conv_id, ch, i, role, text, row_number() OVER (PARTITION BY m.conv_id ORDER BY i) AS place, first_value(ch = 'K' AND r = 's') OVER (PARTITION BY m.conv_id ORDER BY i) AS sys
           FROM m LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM m.conv_id AND e.n = m.n AND ch <> 'I' WHERE ch <> 'D'),
     s AS (SELECT conv_id, sha256(string_agg(CASE ch WHEN 'K' THEN role ELSE CASE WHEN (place - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE ch WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS h FROM k GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_ngram_jaccard_join,
        op3_warc_archive,
        op4_chat_examples,
        op5_pii_sanitisation,
        op6_document_fingerprints,
        op7_toxicity,
        op8_language_id,
        op9_decontamination,
        op10_main_text,
        op11_secret_scan,
        op12_fill_in_middle,
        op13_structure_repair,
    )
} | {"pipeline": corpus_pipeline.run}
SQL = {"op2_ngram_jaccard_join": OP2_SQL, "op3_warc_archive": OP3_SQL, "op4_chat_examples": OP4_SQL, "op12_fill_in_middle": OP12_SQL, "op13_structure_repair": OP13_SQL}
