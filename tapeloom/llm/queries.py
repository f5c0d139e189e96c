"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, embeddings, langid, licenses, lines, media, merkle, mixing, ordered, packing, pii, repeats, simhash


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    got = lines.dedup_lines(_documents(spark, folder))
    return got.select(F.col("id").alias("doc_id"), F.col("kept").alias("text"), "lines_in", "lines_removed", "blocks_removed")


OP1_SQL = f"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM a),
n AS (
  SELECT doc_id, pos, trim(line) AS x, lead(trim(line)) OVER p AS y, lead(pos) OVER p AS pos2
  FROM l WHERE trim(line) <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (
  SELECT doc_id, pos, pos2, 2 AS lines, x || chr(10) || y AS content FROM n WHERE y IS NOT NULL
  UNION ALL SELECT doc_id, pos, pos, 1, x FROM n WHERE length(x) - length(replace(x, ' ', '')) >= {lines.LONG_WORDS - 1}),
later AS (
  SELECT doc_id, pos, pos2 FROM (
    SELECT *, row_number() OVER (PARTITION BY lines, content ORDER BY doc_id, pos) AS k FROM runs) q WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM later UNION ALL SELECT doc_id, pos2 FROM later) q),
m AS (
  SELECT l.doc_id, l.line, l.pos, g.pos IS NOT NULL AS gone,
         g.pos IS NOT NULL AND lag(g.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) IS NULL AS starts
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos)
SELECT d.doc_id,
       CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.gone), '') END AS text,
       count(m.pos) AS lines_in,
       count(m.pos) FILTER (WHERE m.gone) AS lines_removed,
       count(m.pos) FILTER (WHERE m.starts) AS blocks_removed
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text
"""


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    got = repeats.without_repeats(_documents(spark, folder))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["begin"]))
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_media_columns(spark: SparkSession, folder: str) -> DataFrame:
    got = media.stored_text_media(_documents(spark, folder))
    return got.select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )


def op4_embedding_neardup(spark: SparkSession, folder: str) -> DataFrame:
    got = embeddings.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    got = packing.pack(_documents(spark, folder), tokenizer_path())
    return got.withColumnRenamed("id", "doc_id")


def op6_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    got = mixing.mix(_documents(spark, folder))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         strlen(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS dense,
         strlen(regexp_replace(coalesce(text, ''), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', '', 'g')) AS letters,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
k AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size,
         -ln(u) / (CASE WHEN dense > 0 THEN CAST(0.05 AS DOUBLE) + CAST(0.95 AS DOUBLE) * (letters / CAST(dense AS DOUBLE)) ELSE CAST(0.05 AS DOUBLE) END) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w FROM s),
r AS (SELECT *, 3 * source_size AS top, 3 * source_size / CAST(w AS DOUBLE) AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER p, 0)) / CAST(sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS DOUBLE) AS level
  FROM r WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(coalesce(w * max(CASE WHEN ratio > level THEN level END) OVER (), CAST(top AS DOUBLE)), CAST(top AS DOUBLE)) AS target
  FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + CASE WHEN size = 0 THEN 0 WHEN before + size <= budget THEN size WHEN before > budget THEN 0
            ELSE floor((budget - before) / size * size + CAST(0.5 AS DOUBLE)) END AS BIGINT) AS taken
FROM c
"""


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_notices(_documents(spark, folder)).withColumnRenamed("id", "doc_id")


def _op7_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = []
    for rank, (name, text) in enumerate(licenses.TEMPLATES):
        pairs = licenses.bigrams(text)
        rows.append(f"({rank}, {quoted(name)}, {len(pairs)}, {licenses.word_pairs(text)}, [{', '.join(map(quoted, pairs))}])")
    return f"""
WITH t(rank, license, n, width, pairs) AS (VALUES {", ".join(rows)}),
p AS (
  SELECT doc_id, 'line' AS kind, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, 'block', regexp_split_to_array(text, '\n[^A-Za-z0-9]*\n') FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, kind, unnest(parts) AS x, unnest(range(len(parts))) AS unit FROM p),
w AS (
  SELECT doc_id, kind, unit,
         string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS words
  FROM u WHERE kind = 'line' OR contains(x, chr(10))),
a AS (
  SELECT doc_id, kind, unit, len(words) - 1 AS a,
         list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs
  FROM w WHERE len(words) > 1),
s AS (
  SELECT a.doc_id, a.kind, a.unit, t.license, t.rank,
         2 * len(list_intersect(t.pairs, a.pairs)) / CAST(t.n + a.a AS DOUBLE) AS dice
  FROM a JOIN t ON 2 * least(t.n, a.a) >= {licenses.THRESHOLD} * (t.n + a.a)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT r, doc_id, len(words) - 1 AS total, unnest(range(len(words) - 1)) AS place,
         unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pair
  FROM d WHERE len(words) > 1),
tp AS (SELECT rank, license, n, width, unnest(pairs) AS pair FROM t WHERE rank < {len(licenses.NOTICES)}),
hit AS (
  SELECT r, doc_id, total, place, pair, rank, license, n, width FROM b JOIN tp USING (pair)
  QUALIFY count(DISTINCT pair) OVER (PARTITION BY r, rank) >= n * {licenses.THRESHOLD} / (2 - {licenses.THRESHOLD}) - 1e-9),
win AS (
  SELECT x.r, x.doc_id, x.rank, x.license, x.place, least(x.width, x.total - x.place) AS k,
         2 * count(DISTINCT y.pair) / CAST(x.n + least(x.width, x.total - x.place) AS DOUBLE) AS dice
  FROM hit x JOIN hit y ON x.r = y.r AND x.rank = y.rank AND y.place BETWEEN x.place AND x.place + x.width - 1
  GROUP BY x.r, x.doc_id, x.rank, x.license, x.place, x.n, x.width, x.total),
f AS (SELECT * FROM win WHERE dice >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, place ORDER BY dice DESC, rank) = 1)
SELECT doc_id, kind, CAST(unit AS INTEGER) AS unit, license, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, kind, unit ORDER BY dice DESC, rank) AS k FROM s WHERE dice >= {licenses.THRESHOLD}) q
WHERE k = 1
UNION ALL
SELECT doc_id, 'window', CAST(place AS INTEGER), license, dice FROM f x
WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.r = x.r AND y.place <= x.place + x.k AND y.place + y.k >= x.place
                  AND (y.dice > x.dice OR (y.dice = x.dice AND (y.rank < x.rank OR (y.rank = x.rank AND y.place < x.place)))))
"""


PSEUDONYM_KEY = "corpus-pseudonyms-1"  # a deployment passes its own secret


def op8_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymised(_documents(spark, folder), PSEUDONYM_KEY).withColumnRenamed("id", "doc_id")


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    got = simhash.near_duplicates(_documents(spark, folder))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(_documents(spark, folder)).withColumnRenamed("id", "doc_id")


def op11_ordered_packing(spark: SparkSession, folder: str) -> DataFrame:
    return ordered.pack(_documents(spark, folder), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    got = merkle.manifest(_documents(spark, folder))
    refolded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    return got.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), refolded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _op12_sql() -> str:
    mark = lambda x: f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"
    row = lambda text: f"sha256({' || '.join(map(mark, ['doc_id', 'source', 'lang', 'n_chars', text]))})"
    # the checksum bit by bit: a byte is mixed in, then eight shifts
    bits = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) + 256 AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x - 256) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"""
    # the last step inverts all bits, so an even checksum is an odd remainder before it
    tree = lambda name, first: f"""{name} AS (
  {first}
  UNION ALL
  SELECT g, lv + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lv, pos // 3, n),
{name}_sides AS (
  SELECT a.g, a.lv, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
  FROM {name} a JOIN {name} b ON a.g = b.g AND a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.lv, a.pos)"""  # noqa: E731
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS g, {row("text")} AS leaf,
         CASE WHEN {bits} % 2 = 1 THEN {row("replace(text, chr(10), '')")} ELSE {row("text")} END AS given
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{tree("low", "SELECT g, 0 AS lv, pos, leaf AS h, n FROM placed")},
subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{tree("high", "SELECT '' AS g, 0 AS lv, pos, h, n FROM subroots")},
climb AS (
  SELECT doc_id, g, leaf, given, 0 AS lv, pos, given AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, c.given, c.lv + 1, c.pos // 3, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
  FROM climb c JOIN low_sides s ON s.g = c.g AND s.lv = c.lv AND s.pos = c.pos),
up AS (
  SELECT c.doc_id, c.g, c.leaf, c.given, r.h AS subroot, 0 AS lv, r.pos, c.h, c.proof
  FROM climb c JOIN low t ON t.g = c.g AND t.lv = c.lv AND t.pos = c.pos AND t.n = 1 JOIN subroots r ON r.g = c.g
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, c.given, c.subroot, c.lv + 1, c.pos // 3, sha256(s.before || c.h || s.after), c.proof || s.before || s.after
  FROM up c JOIN high_sides s ON s.lv = c.lv AND s.pos = c.pos)
SELECT c.doc_id, c.leaf, c.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM up c JOIN high t ON t.lv = c.lv AND t.pos = c.pos AND t.n = 1
"""


def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    got = centroids.cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return got.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT row_id, vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.row_id, v.vec_id, v.q, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
    FROM v CROSS JOIN c{i} c) x
  GROUP BY row_id, vec_id, q)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(range(64)) AS j, unnest(q) AS x FROM a{i}) y GROUP BY c, j),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM s{i} GROUP BY c),
c{i + 1} AS (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)""")
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), q) - 1 AS c, q FROM v
  QUALIFY c < {k}),
{", ".join(steps)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_media_columns": op3_media_columns,
    "op4_embedding_neardup": op4_embedding_neardup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_source_mixing": op6_source_mixing,
    "op7_license_scan": op7_license_scan,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
    "op11_ordered_packing": op11_ordered_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op6_source_mixing": OP6_SQL,
    "op7_license_scan": _op7_sql(),
    "op12_merkle_manifest": _op12_sql(),
    "op13_centroid_clustering": _op13_sql(),
}
