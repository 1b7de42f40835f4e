"""Queries of this subpackage and their SQL, merged into the repository's by ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, licenses, linedup, mixing, neighbours, phrases, quality, quotes, repair, simhash, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.rebuilt(_read(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.by_source(_read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("th")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("th")


def op10_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document the number of lines, of removed lines, and the MD5 of what is left."""
    out = linedup.dedup_lines(_read(spark, sf_dir, "documents"), extra=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_read(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.mended(_read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_quotes, op3_mixing, op4_simhash, op5_warc, op6_embeddings, op7_quality, op8_decontaminate, op9_licenses, op10_linedup,
        op11_neighbours, op12_phrases, op13_repair,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op8_decontaminate": f"""
WITH i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
       FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM ik)),
n AS (SELECT item_id, count(*) AS n FROM si GROUP BY item_id),
d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s
       FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, count(DISTINCT sd.s) AS c FROM sd JOIN si USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared, c / n AS containment
FROM h JOIN n USING (item_id) WHERE c >= 0.8 * n - 1e-9""",
    "op10_linedup": f"""
WITH a AS (SELECT doc_id, text, hash(text) AS th FROM documents),
lines AS (SELECT doc_id, p, ls[p] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS p
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM a WHERE text IS NOT NULL))),
u AS (SELECT line, min((doc_id, p)) AS pos FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line),
s AS (SELECT line, pos, list_distinct({_WORDS.format("line")}) AS w FROM u),
tok AS (SELECT line, pos, len(w) AS n, unnest(w) AS t FROM s),
df AS (SELECT t, count(*) AS c FROM tok GROUP BY t),
r AS (SELECT tok.*, row_number() OVER (PARTITION BY line ORDER BY c, t) AS i FROM tok JOIN df USING (t)),
pre AS (SELECT * FROM r WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT x.line AS x, y.line AS y FROM pre x JOIN pre y ON x.t = y.t AND y.pos < x.pos
         WHERE least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
late AS (SELECT DISTINCT x FROM (SELECT x, len(list_intersect(a.w, b.w)) AS o, len(a.w) AS n, len(b.w) AS m
         FROM cand JOIN s a ON a.line = x JOIN s b ON b.line = y) WHERE o >= 0.8 * (n + m - o) - 1e-9),
f AS (SELECT l.doc_id, l.p, l.line,
      u.line IS NOT NULL AND (u.pos <> (l.doc_id, l.p) OR late.x IS NOT NULL) AS gone
      FROM lines l LEFT JOIN u ON u.line = l.line LEFT JOIN late ON late.x = l.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
      md5(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_md5 FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, kept_md5
FROM documents LEFT JOIN g USING (doc_id)""",
    "op12_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
m AS (SELECT lang, w, unnest(range(1, least(5, len(w)) + 1)) AS m FROM ws),
g AS (SELECT lang, m, w[s : s + m - 1] AS ph FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM m)),
f AS (SELECT lang, m, ph, count(*) AS f FROM g GROUP BY lang, m, ph HAVING count(*) >= 100),
inside AS (SELECT lang, ph[s : s + k - 1] AS ph, max(f) AS over FROM
           (SELECT lang, ph, f, k, unnest(range(1, m - k + 2)) AS s FROM (SELECT lang, ph, f, m, unnest(range(2, m)) AS k FROM f WHERE m > 2))
           GROUP BY 1, 2),
c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, ph) WHERE m > 1 AND (over IS NULL OR 100 * over < 100 * f)),
cut AS (SELECT lang, m, ph, f AS a, unnest(range(1, m)) AS k FROM c),
s AS (SELECT cut.lang, cut.ph, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = cut.ph[1:k] JOIN f y ON y.lang = cut.lang AND y.ph = cut.ph[k + 1 :] JOIN n ON n.lang = cut.lang),
b AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
}
