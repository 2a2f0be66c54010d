"""Queries of the training-data operators over the given tables.

Each is a thin reading of one operator: production parameters, whole tables,
full results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm import decontam, jaccard, language, lexical, licenses, merkle, orderhash, packing, simhash, suffixes, tokenfile, toxicity, urls
from loamlake.llm.blocks import small_batches
from loamlake.runtime import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, n: int):
    """crc32 of the key as text, modulo ``n``."""
    return F.crc32(F.col(key).cast("string")) % n


@query("op1_language")
def languages(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the chosen languages with their shares."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language.train(docs.filter(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).withColumn("held_out", held_out)


UPPER, LOWER = urls.UPPER, urls.LOWER

NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT a AS node, b AS reached FROM e UNION SELECT node, b FROM r JOIN e ON e.a = reached),
c AS (SELECT node, min(reached) AS least FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""


@query("op2_ngram_jaccard_join", NEAR_SQL)
def near_components(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return jaccard.jaccard_components(table(spark, folder, "documents")).withColumnRenamed("component", "component_id").drop("text_hash")


@query("op3_token_file")
def token_file(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files written."""
    path = scratch_dir(spark, "tokens")
    tokenfile.write_token_file(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenfile.read_token_file(spark, path, ids=False).withColumnRenamed("key", "doc_id")


@query("op4_order_minhash")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = orderhash.neighbours(table(spark, folder, "documents"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = orderhash.with_fingerprint(rows.withColumns({"n_chars": n.cast("bigint"), "edited": edited}).drop("text", "next_text"), "edited", "edited_fingerprint")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        orderhash.as_text("fingerprint").alias("fingerprint"),
        orderhash.as_text("edited_fingerprint").alias("edited_fingerprint"),
        orderhash.likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        orderhash.likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


@query("op5_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    made = toxicity.scores(table(spark, folder, "documents"), table(spark, folder, "labels"), train=fold("doc_id", 5) != 0)
    predicted = (F.col("score") >= 0.5).cast("int")
    return made.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"))


@query("op6_benchmark_decontamination")
def leaks(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, leaked, item_id, n_items, cosine, common, answer."""
    return decontam.judge(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark")).drop("text")


@query("op7_suffix_dedup")
def repeats(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffixes.digests(table(spark, folder, "documents"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _address_sql(url: str) -> str:
    """Columns host, path and address of a url expression."""
    rest = f"CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    query = f"regexp_extract({rest}, '^[^?#]*(\\?[^#]*)', 1)"
    bare = f"regexp_replace({host}, '^(?:www|m)\\.([^.]+\\..+)$', '\\1') || regexp_replace({path}, '(/|\\.html)+$', '') || {query}"
    return f"{host} AS host, {path} AS path, CASE WHEN {host} <> '' THEN {bare} END AS address"


_TARGETS = " || ".join("regexp_extract_all(coalesce(html, ''), '" + p.replace("'", "''") + "', 1)" for p in urls.CANONICAL)
_RULE = "list_max(list_filter([" + ", ".join(
    f"CASE WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'size': {len(h + p)}, 'rule': '{h + p}', 'verdict': '{v}'}} END" for h, p, v in RULES
) + "], lambda x: x IS NOT NULL))"
URL_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, html, {_address_sql("coalesce(url, '')")} FROM pages),
f AS (SELECT page_id, host, path, address, {_RULE} AS found FROM p),
t AS (SELECT host, address AS a, unnest(list_distinct({_TARGETS})) AS target FROM p),
l AS (SELECT a, CASE WHEN starts_with(target, '//') THEN 'http:' || target WHEN contains(target, '://') THEN target
 ELSE 'http://' || host || CASE WHEN starts_with(target, '/') THEN '' ELSE '/' END || target END AS target FROM t WHERE target <> ''),
b AS (SELECT a, host, path, address AS b FROM (SELECT a, {_address_sql("target")} FROM l)),
e AS MATERIALIZED (SELECT a, b FROM b WHERE a <> b UNION SELECT b, a FROM b WHERE a <> b),
r AS (SELECT a AS node, b AS reached FROM e UNION SELECT node, b FROM r JOIN e ON e.a = reached),
c AS (SELECT node, min(least(node, reached)) AS component FROM r GROUP BY 1),
j AS (SELECT f.*, coalesce(c.component, f.address) AS component FROM f LEFT JOIN c ON c.node = f.address),
d AS (SELECT address, found.verdict AS verdict FROM f UNION ALL SELECT b, {_RULE}.verdict FROM b),
g AS (SELECT coalesce(c.component, d.address) AS component, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
 FROM d LEFT JOIN c ON c.node = d.address WHERE verdict IS NOT NULL AND d.address IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict, j.component,
 found IS NULL AND coalesce(blocked AND NOT allowed, false) AS by_alias FROM j LEFT JOIN g ON g.component = j.component"""


@query("op8_url_filters", URL_SQL)
def urls_judged(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, host, path, rule, verdict, component, by_alias."""
    return urls.judge(table(spark, folder, "pages"), RULES)


@query("op9_license_scans")
def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return licenses.scan(table(spark, folder, "documents")).drop("spans")


@query("op10_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    """A row per piece of the packed sequences."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1)


MANIFEST_SQL = f"""WITH RECURSIVE c AS (SELECT list(list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
f AS (SELECT *, list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) AS crc FROM documents, c),
h AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM f),
d AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}'), '-')) END AS seen FROM h),
p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM d),
l AS (SELECT g, 0 AS lvl, pos, leaf AS x, size FROM p UNION ALL SELECT g, lvl + 1, pos // 8, sha256(string_agg(x, '' ORDER BY pos)), (size + 7) // 8 FROM l WHERE size > 1 GROUP BY g, lvl, pos // 8, size),
s AS (SELECT g, x AS subroot, lvl AS height, count(*) OVER () AS size FROM l WHERE size = 1),
m AS (SELECT 0 AS lvl, g AS pos, subroot AS x, size FROM s UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(x, '' ORDER BY pos)), (size + 7) // 8 FROM m WHERE size > 1 GROUP BY lvl, pos // 8, size),
q AS (SELECT p.g, p.pos, l.lvl, l.pos < p.pos >> (3 * l.lvl) AS lo, l.pos > p.pos >> (3 * l.lvl) AS hi, x, l.pos AS nth FROM p JOIN l ON l.g = p.g AND l.size > 1 AND l.pos // 8 = p.pos >> (3 * l.lvl + 3)),
u AS (SELECT s.g, height + m.lvl AS lvl, m.pos < s.g >> (3 * m.lvl) AS lo, m.pos > s.g >> (3 * m.lvl) AS hi, x, m.pos AS nth FROM s JOIN m ON m.size > 1 AND m.pos // 8 = s.g >> (3 * m.lvl + 3)),
a AS (SELECT g, pos, lvl, coalesce(string_agg(x, '' ORDER BY nth) FILTER (lo), '') AS l, coalesce(string_agg(x, '' ORDER BY nth) FILTER (hi), '') AS r
 FROM (SELECT g, pos, lvl, lo, hi, x, nth FROM q UNION ALL SELECT p.g, p.pos, lvl, lo, hi, x, nth FROM p JOIN u ON u.g = p.g) GROUP BY g, pos, lvl),
w AS (SELECT g, pos, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof, list({{'l': l, 'x': '', 'r': r}} ORDER BY lvl) AS path FROM a GROUP BY g, pos),
z AS (SELECT p.*, s.subroot, coalesce(proof, sha256('')) AS proof, list_reduce(list_concat([{{'l': '', 'x': coalesce(seen, leaf), 'r': ''}}], coalesce(path, [])), lambda a, b: {{'l': '', 'x': sha256(b.l || a.x || b.r), 'r': ''}}).x AS folded
 FROM p JOIN s ON s.g = p.g LEFT JOIN w ON w.g = p.g AND w.pos = p.pos)
SELECT doc_id, leaf, subroot, m.x AS root, proof AS proof_sha256, folded AS folded_root, folded = m.x AS verified FROM z, m WHERE m.size = 1"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in merkle.FIELDS]
    changed = F.when(fold("doc_id", 3) == 0, merkle.leaf([*fields[:-1], F.translate("text", UPPER, LOWER)]))
    made = merkle.tree(docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("key"), merkle.leaf(fields).alias("leaf"), changed.alias("seen")))
    folded = made.withColumns({"proof_sha256": merkle.proof(F.col("path")), "folded_root": merkle.fold(F.col("path"), F.coalesce("seen", "leaf"))})
    return folded.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{lexical.TERM}') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
f AS (SELECT row, doc_id, n, term, count(*) AS tf FROM s GROUP BY ALL),
t AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
g AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM f, t GROUP BY term, n_docs),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{lexical.TERM}')) AS term FROM benchmark),
r AS (SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score FROM i JOIN g USING (term) JOIN f USING (term), t GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query("op12_ranked_lexical_search", SEARCH_SQL)
def best_documents(spark: SparkSession, folder: str) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return lexical.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_simhash_near_dedup")
def near_prints(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    made = simhash.near_components(table(spark, folder, "documents"))
    return made.select("doc_id", simhash.as_hex("fingerprint").alias("fingerprint"), F.col("component").alias("component_id"))
