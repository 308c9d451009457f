"""The queries of this subpackage: one ``opN_<name>`` per operator.

Each applies its operator with production parameters to its whole table and
derives the agreed columns from the operator's output."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import covertree, langid, minhash, mixing, prefixtrie, quality, repair, sampling, templates, tokens, urllists, warc, wrappers
from .common import materialize, scratch_path, table


def op1_quality_outliers(spark, sf_dir):
    """Statistics of every document and the robust-outlier verdict."""
    out = quality.quality_outliers(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.round("mahalanobis2", 6).alias("mahalanobis2"))


def op2_warc_revisits(spark, sf_dir):
    """Pages written as deduplicated archives, read back and resolved."""
    path = scratch_path(spark, "warc")
    warc.write_deduplicated(warc.records_of(table(spark, sf_dir, "pages")), path)
    read = materialize(warc.read_archives(spark, path, with_payload=False).drop("payload"), "warc-headers")
    return warc.resolved(read).select(
        F.col("key").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, n, max(page_id) AS top FROM d GROUP BY h, n)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM d JOIN m USING (h, n)
"""


TOKENIZER = "byte_bpe_50k.json"
OVER = 1024


def op3_token_counts(spark, sf_dir):
    """Bytes and tokens of every document under the public byte-level BPE."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokens.token_counts(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
                      (F.col("n_tokens") > OVER).alias("over_limit"))


def op4_cover_tree(spark, sf_dir):
    """Links and components of all embeddings at a cosine of 0.95."""
    out = covertree.cosine_links(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("key").alias("vec_id"), "n_links", "component_id", "kept")


def op5_source_mix(spark, sf_dir):
    """What a mix of all sources at the standing weights takes of every document."""
    out, _ = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_language_id(spark, sf_dir):
    """Language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    docs = docs.withColumn("held_out", F.coalesce(part == 2, F.lit(False)))
    model = langid.fit(docs.where(part != 2))
    return docs.select("doc_id", "held_out", langid.predict(docs, model).alias("p")).select("doc_id", "held_out", "p.*")


def op7_url_lists(spark, sf_dir):
    """Pages as dated captures against dated list entries, both derived from
    the whole pages table (capture times and entries follow from page_id)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    k = F.col("page_id")
    captures = p.withColumn("fetch_time", F.lit(1672531200) + (k * 7919) % 63072000)
    host = urllists.host_of(F.col("url"))
    parent = F.regexp_replace(host, r"^[^.]+\.([^.]+\..+)$", "$1")
    entries = p.select(
        F.when(k % 5 == 0, "malware").when(k % 5 < 4, "spam").otherwise("partners").alias("list"),
        (k % 5 == 4).alias("allow"), F.when(k % 3 == 0, parent).otherwise(host).alias("domain"),
        F.when(k % 7 < 5, "add").otherwise("remove").alias("action"), (F.lit(19358) + (k * 104729) % 900).alias("day"))
    out = urllists.evaluate(captures, urllists.validity_intervals(entries))
    return out.select("page_id", "host", "fetch_day", "n_active", "matched_list", "matched_domain", "blocked")


OP7_SQL = r"""
WITH c AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.'), '') AS host,
                  CAST(floor((1672531200 + (page_id * 7919) % 63072000) / 86400.0) AS BIGINT) AS fetch_day FROM pages),
e AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'malware' WHEN page_id % 5 < 4 THEN 'spam' ELSE 'partners' END AS list,
             CASE WHEN page_id % 3 = 0 THEN regexp_replace(host, '^[^.]+\.([^.]+\..+)$', '\1') ELSE host END AS domain,
             page_id % 7 < 5 AS added, 19358 + (page_id * 104729) % 900 AS day FROM c WHERE host IS NOT NULL),
d AS (SELECT list, domain, day, bool_or(added) AS added FROM e GROUP BY ALL),
k AS (SELECT DISTINCT host, fetch_day FROM c WHERE host IS NOT NULL),
a AS (SELECT host, fetch_day, list, domain, arg_max(added, day) AS active
      FROM k JOIN d ON (host = domain OR ends_with(host, '.' || domain)) AND day <= fetch_day GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY host, fetch_day
             ORDER BY len(string_split(domain, '.')) DESC, list <> 'partners', list, domain) AS rn,
             count(*) OVER (PARTITION BY host, fetch_day) AS n FROM a WHERE active)
SELECT c.page_id, c.host, c.fetch_day, coalesce(r.n, 0) AS n_active, r.list AS matched_list, r.domain AS matched_domain,
       coalesce(r.list <> 'partners', false) AS blocked
FROM c LEFT JOIN r ON c.host = r.host AND c.fetch_day = r.fetch_day AND r.rn = 1
"""


def op8_minhash_odd_sketch(spark, sf_dir):
    """Near-duplicate components of all documents."""
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", "kept")


PIECES = "piece_bpe_32k.model"


def op9_sampled_segmentations(spark, sf_dir):
    """Two distinct sampled segmentations of every document, and whether the
    first decodes to the text again."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sampling.sampled(docs, public_tokenizers.path(PIECES))
    each = lambda f: F.transform("samples", f)
    return out.select(
        F.col("key").alias("doc_id"), F.size("samples").cast("long").alias("n_samples"),
        each(lambda s: F.size(s["ids"]).cast("long")).alias("n_pieces"), each(lambda s: s["inclusion"]).alias("inclusion"),
        each(lambda s: F.xxhash64(s["ids"])).alias("ids_hash"), sampling.restored(F.col("text"), F.col("decoded")).alias("round_trip"))


def op10_line_templates(spark, sf_dir):
    """Every document without the lines whose template recurs in five documents."""
    out = templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", "emptied", F.length("text").cast("long").alias("chars_left"),
                      F.md5("text").alias("text_md5"))


OP10_SQL = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, line_no, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda t: t <> ''),
               lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS t FROM raw),
l AS (SELECT doc_id, line_no, len(t) AS n, t[1:4] AS lead, t[5:] AS rest, greatest(len(t) - 4, 0) AS m FROM tok WHERE len(t) > 0),
s AS (SELECT doc_id, line_no, n, m, lead,
             list_transform(range(8), lambda g: rest[CAST(floor(m * g / 8) AS INT) + 1 : CAST(floor(m * (g + 1) / 8) AS INT)]) AS sl FROM l),
b AS (SELECT n, lead, count(*) AS c FROM s GROUP BY ALL HAVING count(*) >= 5),
x AS (SELECT s.*, b.c FROM s JOIN b USING (n, lead)),
v AS (SELECT n, lead, c, g, sl[g] AS v, count(*) AS k FROM x, (SELECT unnest(range(1, 9)) AS g) GROUP BY ALL HAVING count(*) * 2 > c),
t AS (SELECT doc_id, line_no, x.n, x.lead, x.sl,
             (SELECT coalesce(bool_and(x.sl[v.g] = v.v), true) AND
                     least(x.n, 4) + coalesce(sum(floor(x.m * v.g / 8) - floor(x.m * (v.g - 1) / 8)), 0) >= 0.6 * x.n
              FROM v WHERE v.n = x.n AND v.lead = x.lead) AS shared FROM x),
k AS (SELECT doc_id, line_no, n, lead, CASE WHEN shared THEN NULL ELSE sl END AS own FROM t),
r AS (SELECT n, lead, own, min(doc_id) AS first FROM k GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, k.line_no FROM k JOIN r ON k.n = r.n AND k.lead = r.lead AND k.own IS NOT DISTINCT FROM r.own
      WHERE k.doc_id <> r.first),
a AS (SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY raw.line_no) FILTER (WHERE d.line_no IS NULL) AS txt,
             count(d.line_no) AS gone FROM raw LEFT JOIN d USING (doc_id, line_no) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1)
SELECT o.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(a.gone, 0) AS n_dropped,
       coalesce(a.gone > 0 AND a.gone = c.n_lines, false) AS emptied,
       CASE WHEN o.text IS NOT NULL THEN length(coalesce(a.txt, '')) END AS chars_left,
       CASE WHEN o.text IS NOT NULL THEN md5(coalesce(a.txt, '')) END AS text_md5
FROM documents o LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op11_wrapper_induction(spark, sf_dir):
    """Main text of every page."""
    out = wrappers.main_text(table(spark, sf_dir, "pages"))
    return out.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def damaged_conversations(turns):
    """Conversations with faults that follow from crc32 of ``conv_id:turn``."""
    part = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                     part.alias("part")).where("part <> 0")
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("part") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_conversation_repair(spark, sf_dir):
    """Damaged conversations, what is wrong with each, and its cheapest repair."""
    turns = table(spark, sf_dir, "conversations")
    report, rows = repair.repair(damaged_conversations(turns))
    ids = turns.select("conv_id", repair.key_of("conv_id").alias("k")).distinct()
    out = ids.join(report, "k", "left").join(repair.digests(rows, "digest"), "k", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_prefix_trie(spark, sf_dir):
    """Prefix trie of all conversations, each rebuilt on the first turns of another."""
    hashed = materialize(prefixtrie.turn_hashes(table(spark, sf_dir, "conversations")), "turn-hashes")
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).cast("int")
    convs = prefixtrie.rebuilt(hashed, F.col("conv") - F.col("conv") % 5, taken)
    out = prefixtrie.trie(prefixtrie.sequences(convs))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                      F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


QUERIES = {f.__name__: f for f in (op1_quality_outliers, op2_warc_revisits, op3_token_counts, op4_cover_tree, op5_source_mix, op6_language_id, op7_url_lists, op8_minhash_odd_sketch, op9_sampled_segmentations, op10_line_templates,
                                  op11_wrapper_induction, op12_conversation_repair, op13_prefix_trie)}
ORACLE: dict[str, str] = {"op2_warc_revisits": OP2_SQL, "op7_url_lists": OP7_SQL, "op10_line_templates": OP10_SQL}
