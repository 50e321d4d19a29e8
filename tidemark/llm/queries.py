"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread
from . import bpe, centroid_walk, decontam, hamming, html_extract, license_scan, line_dedup, ngram_join, quality, rlz_dedup, token_output, warc, whitening
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"))
    return warc.read_warc(manifest, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring(docs, count="n_dropped")


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=10)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    file = known.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), file, known.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as known

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_output.write_token_files(docs, known.path("byte_bpe_50k.json"), end_id=0)
    return token_output.read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(whitening.whole_vectors(table(spark, sf_dir, "embeddings"), scale=64, shift=1_000_000), components=32)


def op12_centroid_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroid_walk.whole_vectors(table(spark, sf_dir, "embeddings"), dims=64, scale=1024)
    start = F.asc_nulls_last(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    found = centroid_walk.cluster(vectors, start, k=8, rounds=10)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_walk.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rlz_dedup.drop_repeated(docs, kept=lambda words: F.sha2(words, 256)).withColumnRenamed("kept", "kept_sha256")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_ranking": op2_quality_ranking,
    "op3_line_templates": op3_line_templates,
    "op4_hamming_topk": op4_hamming_topk,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_html_extract": op8_html_extract,
    "op9_token_output": op9_token_output,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_walk": op12_centroid_walk,
    "op13_rlz_dedup": op13_rlz_dedup,
}

def _centroid_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round a CTE after the one before it."""
    nearest = """a{r} AS MATERIALIZED (SELECT rid, x, min(d * {k} + cluster) % {k} AS cluster, min(d) AS d FROM (
            SELECT rid, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{r}) GROUP BY rid, x)"""
    means = """s{r} AS MATERIALIZED (SELECT cluster, list(m ORDER BY dim) AS c FROM (
            SELECT cluster, dim, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (
                SELECT cluster, unnest(x) AS v, unnest(range(64)) AS dim FROM a{r}) GROUP BY cluster, dim) GROUP BY cluster),
        c{n} AS MATERIALIZED (SELECT cluster, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (cluster))"""
    steps = [f"{nearest.format(r=r, k=k)},\n        {means.format(r=r, n=r + 1)}" for r in range(rounds)] + [nearest.format(r=rounds, k=k)]
    return f"""
        WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS cluster, x AS c FROM (SELECT sha256('3:' || vec_id) AS h, x FROM kept ORDER BY h, x LIMIT {k})),
        {", ".join(steps)},
        cost AS (SELECT cluster, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY cluster)
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN cost USING (cluster) JOIN c{rounds} USING (cluster)
    """


_licences = ", ".join(f"({t}, '{label}', '{text}', '{key}')" for t, (label, text, key) in enumerate(license_scan.TEMPLATES))
_phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.BASE.items())

ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH sized AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        kept AS (SELECT h, max(page_id) AS keeper FROM sized GROUP BY h),
        digits AS (SELECT h, array_to_string(list_transform(range(32), lambda g: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(
            list_transform(range(5), lambda b: ((strpos('0123456789abcdef', h[(g * 5 + b) // 4 + 1]) - 1) >> (3 - (g * 5 + b) % 4)) % 2 * (1 << (4 - b)))) AS INTEGER) + 1, 1)), '') AS payload_digest
            FROM (SELECT DISTINCT h FROM sized))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keeper THEN keeper END AS refers_to
        FROM sized JOIN kept USING (h) JOIN digits USING (h)
    """,
    "op10_license_scan": rf"""
        WITH files AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        placed AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM files),
        licences AS (SELECT t, label, string_split(text, ' ') AS words, string_split(key, ' ') AS phrase, strpos(' ' || text || ' ', ' ' || key || ' ') AS cut, text FROM (VALUES {_licences}) v(t, label, text, key)),
        templates AS (SELECT t, label, words, phrase, len(string_split(left(text, cut - 1), ' ')) - 1 AS key_at FROM licences),
        phrases AS (SELECT label, string_split(phrase, ' ') AS phrase FROM (VALUES {_phrases}) v(phrase, label)),
        idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT r) + 1)) + 0.01 AS weight
            FROM (SELECT DISTINCT unnest(words) AS word FROM templates) LEFT JOIN placed USING (word) GROUP BY word),
        bases AS (SELECT r, p.label, pos AS start FROM placed JOIN phrases p ON word = p.phrase[1] JOIN files USING (r) WHERE w[pos + 1 : pos + len(p.phrase)] = p.phrase),
        founds AS (SELECT r, t, label, words, key_at, len(phrase) AS key_n, pos - key_at AS start FROM placed JOIN templates ON word = phrase[1] JOIN files USING (r) WHERE w[pos + 1 : pos + len(phrase)] = phrase),
        spelled AS (SELECT r, t, label, start, key_at, key_n, unnest(words) AS word, unnest(range(len(words))) AS k FROM founds),
        near AS (SELECT *, k BETWEEN key_at - {license_scan.NEAR} AND key_at + key_n - 1 + {license_scan.NEAR} AND NOT k BETWEEN key_at AND key_at + key_n - 1 AS beside FROM spelled),
        covers AS (SELECT s.r, s.t, s.label, s.start, sum(CASE WHEN p.word = s.word THEN weight ELSE 0 END) / sum(weight) AS cover
            FROM near s JOIN idf ON idf.word = s.word LEFT JOIN placed p ON p.r = s.r AND p.pos = s.start + k GROUP BY s.r, s.t, s.label, s.start
            HAVING coalesce(sum(CASE WHEN p.word = s.word THEN weight ELSE 0 END) FILTER (beside), 0) >= {license_scan.SHARE} * coalesce(sum(weight) FILTER (beside), 0) - 1e-9),
        based AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS own FROM bases GROUP BY r),
        matched AS (SELECT r, list(DISTINCT label) AS found, max(cover) AS cover FROM covers GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(coalesce(own, []) || coalesce(found, []))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0 ELSE round(coalesce(cover, 0), 6) END AS score
        FROM files LEFT JOIN based USING (r) LEFT JOIN matched USING (r)
    """,
    "op3_line_templates": r"""
        WITH texts AS (SELECT DISTINCT text, md5(text) AS th FROM documents WHERE text IS NOT NULL),
        cut AS (SELECT th, unnest(a) AS line, unnest(range(len(a))) AS pos
            FROM (SELECT th, string_split(regexp_replace(text, '[\t\r\f][ \t\r\f]*| [ \t\r\f]+', ' ', 'g'), chr(10)) AS a FROM texts)),
        lines AS (SELECT th, pos, words, len(words) AS n, words[1:3] AS heads FROM (
            SELECT th, pos, list_transform(string_split(trim(line), ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]|@|://') THEN '<*>' ELSE w END) AS words
            FROM cut WHERE trim(line) <> '')),
        firsts AS (SELECT n, heads, min(th) AS first, count(DISTINCT th) < 10 AS narrow FROM lines GROUP BY n, heads HAVING count(DISTINCT th) > 1),
        whole AS (SELECT th, count(*) AS lines, sum(n) AS tokens FROM lines GROUP BY th),
        parts AS (SELECT th, first, count(*) AS c, sum(n) AS t, count(*) FILTER (narrow) AS few FROM lines JOIN firsts USING (n, heads) GROUP BY th, first),
        best AS (SELECT *, sum(c) FILTER (th <> first) OVER (PARTITION BY th) AS all_c, sum(t) FILTER (th <> first) OVER (PARTITION BY th) AS all_t,
                sum(c) OVER (PARTITION BY th) AS shared_c, sum(t) OVER (PARTITION BY th) AS shared_t FROM parts
            QUALIFY row_number() OVER (PARTITION BY th ORDER BY th = first, c DESC, t DESC, first DESC) = 1),
        copies AS (SELECT th, first AS g FROM best JOIN whole USING (th) WHERE th <> first AND c * 2 > lines - (all_c - c) AND t * 2 > tokens - (all_t - t)
                AND (few > 0 OR shared_c = lines OR c >= 4 AND c >= (c + lines - shared_c) * 0.8 AND t >= (t + tokens - shared_t) * 0.8)),
        grouped AS (SELECT l.*, coalesce(g, th) AS g FROM lines l LEFT JOIN copies USING (th)),
        leaves AS (SELECT n, heads, count(DISTINCT g) AS reach FROM grouped GROUP BY n, heads HAVING count(DISTINCT g) >= 10 OR n >= 12 AND count(DISTINCT g) >= 2),
        hot AS (SELECT * FROM grouped JOIN leaves USING (n, heads)),
        forms AS (SELECT n, heads, reach, words, count(DISTINCT g) AS docs FROM hot GROUP BY n, heads, reach, words),
        placed AS (SELECT n, heads, reach, words, docs, unnest(words) AS word, unnest(range(n)) AS spot FROM forms),
        support AS (SELECT n, heads, spot, word, CASE WHEN word = '<*>' THEN 0 ELSE sum(docs) END AS support FROM placed GROUP BY n, heads, spot, word),
        parsed AS (
            SELECT n, heads, reach, words,
                   list(CASE WHEN support >= 10 THEN word ELSE '<*>' END ORDER BY spot) AS t1, avg(CASE WHEN support >= 10 THEN 1 ELSE 0 END) AS s1,
                   list(CASE WHEN support >= 2 THEN word ELSE '<*>' END ORDER BY spot) AS t2, avg(CASE WHEN support >= 2 THEN 1 ELSE 0 END) AS s2
            FROM placed JOIN support USING (n, heads, spot, word) GROUP BY n, heads, reach, words),
        named AS (
            SELECT n, heads, words, 10 AS least, t1 AS template FROM parsed WHERE s1 >= 0.6 AND reach >= 10
            UNION ALL SELECT n, heads, words, 2, t2 FROM parsed WHERE s2 >= 0.8 AND n >= 12),
        recurs AS (SELECT n, heads, least, template FROM hot JOIN named USING (n, heads, words) GROUP BY n, heads, least, template HAVING count(DISTINCT g) >= least),
        gone AS (SELECT th, list(DISTINCT pos) AS gone FROM hot JOIN named USING (n, heads, words) JOIN recurs USING (n, heads, least, template) GROUP BY th)
        SELECT doc_id,
               CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(
                   list_filter(range(len(string_split(text, chr(10)))), lambda i: NOT list_contains(gone, i)),
                   lambda i: string_split(text, chr(10))[i + 1]), chr(10)) END AS text,
               CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
        FROM documents LEFT JOIN gone ON md5(text) = th
    """,
    "op4_hamming_topk": """
        WITH codes AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
            FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, d.vec_id AS neighbor_id,
                   CAST(list_sum(list_transform(list_zip(q.bits, d.bits), lambda z: abs(z[1] - z[2]))) AS INTEGER) AS distance
            FROM codes q, codes d WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, distance
            FROM pairs)
        SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
    """,
    "op12_centroid_walk": _centroid_sql(),
    "op13_rlz_dedup": rf"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        placed AS (SELECT r, w, unnest(range(greatest(len(w) - {rlz_dedup.LEAST - 1}, 0))) AS s FROM texts),
        windows AS (SELECT r, s, md5(array_to_string(w[s + 1 : s + {rlz_dedup.LEAST}], ' ')) AS h FROM placed),
        gone AS (SELECT DISTINCT r, unnest(range(s, s + {rlz_dedup.LEAST})) AS k FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
        words AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS k FROM texts),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n_kept FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts LEFT JOIN kept USING (r)
    """,
}
