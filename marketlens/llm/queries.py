"""The corpus operators' queries with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import bpe, chat, decontaminate, fim, lm, manifest, media, pieces, quality, simhash, suffixes, urls, warc
from marketlens.llm.common import residue, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: host/path rules of the URL query.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stream_digest(table(spark, sf_dir, "documents")).select("doc_id", "stream.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    return scored.select("doc_id", (residue(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "bpe.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id",
        "hits.n_words",
        F.size("hits.hit_words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
        F.array_join(F.transform(decontaminate.spans("text", "hits.hit_words"), lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("spans"),
    )


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), vocabulary())


#: The tool that a user turn calls in op8, and the arguments it takes.
REPLY = [chat.Field("prompt", "string", least=1, most=600), chat.Field("turn", "integer", least=0)]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as calls of one tool, assistant turns as results of the turn before; a call follows the user turn two
    before.  Turns of any other role, or of none, are messages."""
    rows = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - back).cast("string"))
    calls = rows.where(F.col("role") == "user").select(
        name(0).alias("id"), F.col("turn").alias("seq"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.when(F.col("turn") >= 2, name(2)).alias("after")
    )
    results = rows.where(F.col("role") == "assistant").select(name(1).alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    others = rows.where(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))).select(name(0).alias("id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return chat.link(calls, results, {"reply": REPLY}, others)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True).select("doc_id", "dedup.*")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of all pages against a replica that lacks pages, has others, and has bodies damaged at equal and at other length."""
    pages = table(spark, sf_dir, "pages")
    k, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    body = F.when((k % 97 == 13) & (F.length(html) > 0), F.concat(F.lit("~"), F.substring(html, 2, 2147483647))).when(k % 101 == 7, F.concat(html, F.lit("!"))).otherwise(html)
    kept = pages.where(F.coalesce(k % 89 != 7, F.lit(True))).withColumn("html", body)
    added = pages.where(k % 103 == 5).withColumn("page_id", -k - 1)
    return warc.audit(pages, kept.unionByName(added))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_digest(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "pieces.*")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fim.restore(F.col("fim.output"), F.col("fim.form"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", hashed(F.col("fim.output")).alias("output_sha256"), hashed(restored).alias("restored_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"), manifest.tampered())


QUERIES = {
    "op1_urls": op1_urls,
    "op2_simhash": op2_simhash,
    "op3_media": op3_media,
    "op4_quality": op4_quality,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_lm": op7_lm,
    "op8_chat": op8_chat,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "op11_pieces": op11_pieces,
    "op12_fim": op12_fim,
    "op13_manifest": op13_manifest,
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\x{80}-\\x{10FFFF}]+'), lambda x: x <> '')"

_OP6 = f"""WITH D AS (SELECT doc_id, {_WORDS} w FROM documents), I AS (SELECT CAST(item_id AS VARCHAR) item, {_WORDS} w FROM benchmark),
B AS (SELECT DISTINCT item, least(len(w), 13) n, array_to_string(w[i:i + 12], ' ') t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) i FROM I WHERE len(w) > 0)),
X AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM D, (SELECT DISTINCT n FROM B) WHERE len(w) >= n)),
H AS (SELECT doc_id, item, i, n FROM X JOIN B USING (n, t)),
W AS (SELECT doc_id, count(DISTINCT k) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) k FROM H) GROUP BY 1),
T AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, item FROM H WHERE item IS NOT NULL) GROUP BY 1),
S0 AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') g, regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+') o FROM documents WHERE doc_id IN (SELECT doc_id FROM H)),
S1 AS (SELECT doc_id, k, g, o, CASE WHEN regexp_matches(t, '^[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]') THEN 0 ELSE 1 END f FROM S0 JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + n)) k FROM H) USING (doc_id)),
S2 AS (SELECT doc_id, k, CAST(list_sum(list_transform(o[1:k - 1], lambda x: length(x))) AS BIGINT) a, CAST(list_sum(list_transform(g[1:k - 1 + f], lambda x: length(x))) AS BIGINT) b, length(o[k]) c FROM S1),
S3 AS (SELECT doc_id, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) r, coalesce(a, 0) + coalesce(b, 0) p, c FROM S2),
S4 AS (SELECT doc_id, string_agg(p || '-' || q, ',' ORDER BY p) spans FROM (SELECT doc_id, r, min(p) p, max(p + c) q FROM S3 GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated, coalesce(spans, '') spans
FROM D LEFT JOIN W USING (doc_id) LEFT JOIN T USING (doc_id) LEFT JOIN S4 USING (doc_id)"""

_OP8 = """WITH RECURSIVE K AS (SELECT 'c' || conv_id || '-' || turn id, turn, text, CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS after FROM conversations WHERE role = 'user'),
R AS (SELECT 'c' || conv_id || '-' || (turn - 1) id, turn, text FROM conversations WHERE role = 'assistant'),
F AS (SELECT id, count(*) n_results, arg_min(text, (turn, text)) content FROM R GROUP BY 1),
V(id, level) AS (SELECT id, CAST(0 AS BIGINT) FROM K WHERE after IS NULL OR after NOT IN (SELECT id FROM K) UNION ALL SELECT K.id, V.level + 1 FROM K JOIN V ON K.after = V.id)
SELECT 'call' kind, K.id, turn seq, level, coalesce(n_results, 0) n_results,
 concat_ws('; ', CASE WHEN length(text) < 1 THEN 'prompt: below 1' WHEN length(text) > 600 THEN 'prompt: above 600' END, CASE WHEN after IS NOT NULL AND after NOT IN (SELECT id FROM K) THEN 'depends on an unknown call' END) errors,
 '{"arguments":{"prompt":' || to_json(text) || ',"turn":' || turn || '},"id":' || to_json(K.id) || ',"level":' || level || ',"name":"reply","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' line
FROM K JOIN V ON K.id = V.id LEFT JOIN F ON K.id = F.id
UNION ALL SELECT 'orphan', id, turn, NULL, 1, 'no call', '{"id":' || to_json(id) || ',"result":' || to_json(text) || '}' FROM R WHERE id NOT IN (SELECT id FROM K)
UNION ALL SELECT 'message', 'c' || conv_id || '-' || turn, turn, NULL, 0, '', '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"id":' || to_json('c' || conv_id || '-' || turn) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')"""

_OP9 = """WITH D AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) h, strlen(coalesce(text, '')) n FROM documents),
C AS (SELECT doc_id, n, c, h[1024 * c + 1:1024 * c + 1422] x FROM (SELECT doc_id, h, n, unnest(range(0, (n + 511) // 512)) c FROM D WHERE n >= 200)),
P AS (SELECT doc_id, 512 * c + j p, md5_number(x[2 * j + 1:2 * j + 400]) k FROM (SELECT doc_id, c, x, unnest(range(0, least(512, n - 199 - 512 * c))) j FROM C)),
M AS (SELECT doc_id, p FROM P WHERE k IN (SELECT k FROM P GROUP BY 1 HAVING count(*) > 1)),
S AS (SELECT doc_id, min(p) a, max(p) + 200 b FROM (SELECT doc_id, p, sum(o) OVER (PARTITION BY doc_id ORDER BY p) g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200 THEN 1 ELSE 0 END o FROM M)) GROUP BY doc_id, g),
E AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) f, a t FROM S UNION ALL SELECT doc_id, max(b), NULL FROM S GROUP BY 1),
K AS (SELECT doc_id, string_agg(h[2 * f + 1:2 * coalesce(t, n)], '' ORDER BY f) kept FROM E JOIN D USING (doc_id) GROUP BY 1),
N AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) n_removed, count(*) n_spans FROM S GROUP BY 1)
SELECT doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 FROM D LEFT JOIN K USING (doc_id) LEFT JOIN N USING (doc_id)"""

_OP10 = f"""WITH A AS (SELECT page_id, url, coalesce(html, '') body FROM pages),
B AS (SELECT page_id, url, CASE WHEN page_id % 97 = 13 AND length(body) > 0 THEN '~' || body[2:] WHEN page_id % 101 = 7 THEN body || '!' ELSE body END body FROM A WHERE coalesce(page_id % 89 <> 7, true)
 UNION ALL SELECT -page_id - 1, url, body FROM A WHERE page_id % 103 = 5),
X AS (SELECT 'a' side, * FROM A UNION ALL SELECT 'b', * FROM B),
R AS (SELECT side, page_id, 'WARC/1.1' || e || 'WARC-Type: response' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || e ||
 'Content-Length: ' || strlen(body) || e || e || body || e || e record FROM X, (SELECT chr(13) || chr(10) e)),
D AS (SELECT side, page_id, sha256(record) digest, strlen(record) length, count(*) copies FROM R GROUP BY ALL),
P AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, digest) - 1 place FROM D WHERE side = 'a'),
L AS (SELECT *, place // {warc.RECORDS} file_no, place % {warc.RECORDS} record_no, CAST(coalesce(sum(length * copies) OVER (PARTITION BY place // {warc.RECORDS} ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM P),
Q AS (SELECT * FROM D WHERE side = 'b')
SELECT L.page_id, L.file_no, L.record_no, L.offset, L.length, L.digest, L.copies, CASE WHEN L.copies = Q.copies THEN 'intact' WHEN Q.copies IS NOT NULL THEN 'copies'
 WHEN EXISTS (SELECT 1 FROM Q x WHERE x.page_id IS NOT DISTINCT FROM L.page_id AND NOT EXISTS (SELECT 1 FROM L y WHERE y.page_id IS NOT DISTINCT FROM x.page_id AND y.digest = x.digest)) THEN 'damaged' ELSE 'missing' END status
FROM L LEFT JOIN Q ON L.page_id IS NOT DISTINCT FROM Q.page_id AND L.digest = Q.digest
UNION ALL SELECT Q.page_id, coalesce((SELECT max(file_no) FROM L WHERE record_no = 0 AND (L.page_id, L.digest) <= (Q.page_id, Q.digest)), 0), NULL, NULL, Q.length, Q.digest, Q.copies, 'extra' FROM Q
WHERE NOT EXISTS (SELECT 1 FROM L WHERE L.page_id IS NOT DISTINCT FROM Q.page_id)"""

_OP12 = """WITH D AS (SELECT doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) h FROM documents),
H AS (SELECT doc_id, t, u, len(u) n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) h FROM D),
C AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END form FROM H),
P AS (SELECT *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s FROM C)
SELECT doc_id, CAST(n AS BIGINT) n, form, CASE WHEN form <> 'plain' THEN length(p) END prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) output_sha256, sha256(p || m || s) restored_sha256 FROM P"""


def _op13() -> str:
    """The tree level by level, ``depth`` levels of a source and as many of the sources; a tree of one node stays as it is."""
    fan, depth = manifest.FAN, 6
    shown = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: f"sha256({' || '.join(shown(text if c == 'text' else c) for c in manifest.FIELDS)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        "Z AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) z FROM range(256) r(i))",
        "E AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') k FROM documents)",
        "F AS (SELECT *, xor(list_reduce(range(1, length(k) + 1), lambda c, j: xor(c >> 8, z[(xor(c, CAST(ascii(k[j]) AS BIGINT)) & 255) + 1]), 4294967295), 4294967295) % 5 = 0 bad FROM E, Z)",
        f"L AS (SELECT source, doc_id, {leaf('text')} leaf, CASE WHEN bad THEN {leaf(lower)} ELSE {leaf('text')} END present FROM F)",
        "S0 AS (SELECT source g, source, leaf h, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 p, count(*) OVER (PARTITION BY source) c, doc_id, leaf, present FROM L)",
    ]

    def tree(name: str) -> str:
        """Steps name1 ... of runs joined and hashed; the last has one node a group."""
        for k in range(depth):
            steps.append(f"{name}R{k} AS (SELECT g, p // {fan} p, any_value(c) c, string_agg(h, '' ORDER BY p) t FROM {name}{k} GROUP BY g, p // {fan})")
            steps.append(f"{name}{k + 1} AS (SELECT g, p, (c + {fan - 1}) // {fan} c, CASE WHEN c > 1 THEN sha256(t) ELSE t END h FROM {name}R{k})")
        return f"{name}{depth}"

    top = tree("S")
    steps.append(f"T0 AS (SELECT 0 g, g source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 p, count(*) OVER () c FROM {top})")
    whole = tree("T")
    last = "SELECT S0.doc_id, S0.leaf, S0.present f, '' q, S0.g, S0.p, T0.h subroot, T0.p tp FROM S0 JOIN T0 ON T0.source IS NOT DISTINCT FROM S0.g"
    for name, key, group in [("S", "p", "w.g"), ("T", "tp", "0")]:
        for k in range(depth):
            i = f"64 * (w.{key} // {fan**k} % {fan})"
            left, right = f"substr(r.t, 1, {i})", f"substr(r.t, {i} + 65)"
            last = f"SELECT w.* REPLACE (CASE WHEN r.c > 1 THEN sha256({left} || w.f || {right}) ELSE w.f END AS f, CASE WHEN r.c > 1 THEN w.q || {left} || {right} ELSE w.q END AS q) FROM ({last}) w JOIN {name}R{k} r ON r.g IS NOT DISTINCT FROM {group} AND r.p = w.{key} // {fan ** (k + 1)}"
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, x.h root, sha256(q) proof_sha256, f folded_root, f = x.h verified FROM ({last}) y, {whole} x"


#: SQL for the queries that SQL can express; the others are tested against plain versions in tests/llm.
SQL: dict[str, str] = {"op6_decontaminate": _OP6, "op8_chat": _OP8, "op9_suffix_dedup": _OP9, "op10_warc": _OP10, "op12_fim": _OP12, "op13_manifest": _op13()}
