"""The llm operators applied to their whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, decontaminate, fingerprints, lm, middle, mixing, neardup, personal, pieces, quality, repeats, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces_digest(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlap_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.spans_digest(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.middle_digest(table(spark, sf_dir, "documents"))


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.label_features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language_model": op2_language_model,
    "op3_fingerprints": op3_fingerprints,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_sharding": op5_sharding,
    "op6_repeats": op6_repeats,
    "op7_pieces": op7_pieces,
    "op8_decontamination": op8_decontamination,
    "op9_personal_data": op9_personal_data,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_point_in_time": op12_point_in_time,
    "op13_mixing": op13_mixing,
}


def _crc_step(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: For crc32 in SQL: what the polynomial makes of each byte.
_CRC = [_crc_step(i) for i in range(256)]

ORACLES: dict[str, str] = {
    "op5_sharding": f"""
        WITH sized AS (
          SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
            xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
              lambda c, b: xor(({_CRC})[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
          FROM documents),
        placed AS (
          SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
            sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, text_crc32, size) AS pos
          FROM sized),
        dealt AS (SELECT *, least(15, ((2 * p + size) * 16 // (2 * total)))::INT AS shard FROM placed)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM dealt""",
    "op4_near_duplicates": r"""
        WITH RECURSIVE doc AS (
          SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
          FROM documents),
        shingle AS (SELECT DISTINCT r, doc_id, ws[i:i + 4] AS s FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM doc WHERE len(ws) > 0)),
        size AS (SELECT r, count(*) AS n FROM shingle GROUP BY r),
        shared AS (SELECT a.r AS x, b.r AS y, a.doc_id AS dx, b.doc_id AS dy, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.r < b.r GROUP BY ALL),
        link AS (SELECT dx, dy FROM shared JOIN size p ON p.r = x JOIN size q ON q.r = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        pairs AS (SELECT dx AS a, dy AS b FROM link UNION SELECT dy, dx FROM link),
        reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
        least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
        FROM doc LEFT JOIN size USING (r) JOIN least_ ON least_.a = doc.doc_id""",
    "op6_repeats": r"""
        WITH doc AS (
          SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
        win AS (SELECT r, doc_id, i, ws[i:i + 19] AS w FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM doc WHERE len(ws) >= 20)),
        placed AS (SELECT r, i, {'d': doc_id, 'i': i} AS here, min({'d': doc_id, 'i': i}) OVER (PARTITION BY w) AS earliest FROM win),
        gone AS (SELECT r, list(DISTINCT pos) AS gone FROM (SELECT r, unnest(range(i, i + 20)) AS pos FROM placed WHERE here > earliest) GROUP BY r),
        kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS body FROM (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM doc) LEFT JOIN gone USING (r)
          WHERE gone IS NULL OR NOT list_contains(gone, i) GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM doc LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)""",
    "op8_decontamination": r"""
        WITH item AS (
          SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws
          FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        win AS (
          SELECT DISTINCT item, least(10, len(ws)) AS k, ws[i:i + least(10, len(ws)) - 1] AS w
          FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM item WHERE len(ws) > 0)),
        doc AS (
          SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws
          FROM documents),
        grams AS (SELECT r, i, k, ws[i:i + k - 1] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM doc) , (SELECT DISTINCT k FROM win) WHERE i + k - 1 <= len(ws)),
        occ AS (SELECT g.r, g.i, g.k, win.item FROM grams g JOIN win ON g.k = win.k AND g.w = win.w),
        hit AS (SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM occ) GROUP BY r),
        found AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY r)
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM doc LEFT JOIN hit USING (r) LEFT JOIN found USING (r)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM m""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT doc_id, text, us, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b,
          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    "op12_point_in_time": """
        WITH h AS (SELECT doc_id, source, n_chars, lang, sha256(doc_id::VARCHAR) AS h FROM documents),
        v AS (SELECT doc_id, source, n_chars, lang, ('0x' || h[1:8])::BIGINT % 50000 AS event, ('0x' || h[1:8])::BIGINT % 50000 - 60 + ('0x' || h[9:16])::BIGINT % 600 AS arrival,
          ('0x' || h[1:8])::BIGINT % 50000 + ('0x' || h[17:24])::BIGINT % 900 AS expiry FROM h),
        q AS (SELECT row_number() OVER () AS r, l.doc_id, ('0x' || sha256(l.doc_id::VARCHAR)[25:32])::BIGINT % 50000 AS t, s.source
          FROM labels l LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id) s USING (doc_id)),
        won AS (SELECT r, v.* FROM q JOIN v ON v.source = q.source AND event <= t AND arrival <= t AND t < expiry
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival, v.doc_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) = 1)
        SELECT q.doc_id, t, won.doc_id AS version_id, t - event AS age, CASE WHEN won.doc_id IS NULL THEN 'none' WHEN t - event > 120 THEN 'stale' ELSE 'fresh' END AS status,
          CASE WHEN t - event <= 120 THEN n_chars END AS n_chars, CASE WHEN t - event <= 120 THEN lang END AS lang FROM q LEFT JOIN won USING (r)""",
    # a source's slots take the first blocks of its words, laid out twice: so many words, whatever the slots' order
    "op13_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        whole AS (SELECT floor(1.5::DOUBLE * sum(size))::BIGINT AS words, greatest(1, ceil(floor(1.5::DOUBLE * sum(size)) / 262144))::BIGINT AS step, 1.5::DOUBLE * sum(size) AS share FROM d),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][number % 3 + 1] AS w, 2 * source_size AS most FROM s),
        l AS (SELECT w.*, (share - coalesce(sum(most) OVER (ORDER BY most / w, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(w) OVER (ORDER BY most / w, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w, whole),
        t AS (SELECT *, coalesce(least(most::DOUBLE, (SELECT level FROM l WHERE level * w <= most ORDER BY most / w, number LIMIT 1) * w), most::DOUBLE) AS target FROM l),
        high AS (SELECT *, CASE WHEN number = max(number) OVER () THEN 1 ELSE sum(target) OVER (ORDER BY number ROWS UNBOUNDED PRECEDING) / sum(target) OVER () END AS high FROM t),
        share AS (SELECT *, coalesce(lag(high) OVER (ORDER BY number), 0) AS low FROM high),
        points AS (SELECT (k::HUGEINT * 618033988749894848 % 1000000000000000000)::DOUBLE / 1e18::DOUBLE AS x FROM (SELECT unnest(range((words + step - 1) // step)) AS k FROM whole)),
        slots AS (SELECT number, count(x) AS slots FROM share LEFT JOIN points ON low <= x AND x < high GROUP BY number),
        laid AS (SELECT d.doc_id, d.size, source_size, target, slots * step AS stop,
            coalesce(sum(d.size) OVER (PARTITION BY number ORDER BY md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.size)[1:13], d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
          FROM d JOIN share ON d.source IS NOT DISTINCT FROM share.source JOIN slots USING (number), whole)
        SELECT doc_id, size, source_size, target, (greatest(0, least(size, stop - start)) + greatest(0, least(size, stop - source_size - start)))::BIGINT AS taken FROM laid""",
}
