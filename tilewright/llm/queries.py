"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embedding_dedup, html_text, language, packing, pii, quality, repeats, shingle_join, urls
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), without=("text", "n_chars"))
    return scored.select("doc_id", "source", "lang", "doc_score", "site_score", "path_score", "quality_score", "keep")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.jaccard_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))  # a null id is in no fifth
    judged = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), docs.where(~held_out))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_quality_classifier, op3_ngram_jaccard_join, op4_language_id, op5_pii, op6_html_extraction, op7_decontamination, op8_url_filter, op9_packing, op10_embedding_dedup)}

#: All pairs by their common words or components, and the closure of their links: for tables of a few thousand rows.
_CLOSURE = """
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

#: Kinds in their order, with patterns as plain SQL has them; the borders of an IBAN are word borders here.
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("iban", r"\b[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]){11,30}\b"),
)
_OF_KIND = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps FROM docs" for k, (kind, pattern) in enumerate(_PII))
_DIGIT = "CAST(substr(d, length(d) - {i}, 1) AS INTEGER)"
_LUHN = " + ".join(f"CASE WHEN length(d) > {i} THEN {_DIGIT.format(i=i) if i % 2 == 0 else f'(CASE WHEN {_DIGIT.format(i=i)} > 4 THEN 2 * {_DIGIT.format(i=i)} - 9 ELSE 2 * {_DIGIT.format(i=i)} END)'} ELSE 0 END" for i in range(19))
_LETTERS = "substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4)"
for _k in range(26):
    _LETTERS = f"replace({_LETTERS}, '{chr(65 + _k)}', '{10 + _k}')"
_REST = "0"  # the number in pieces of 15 digits, each after the rest of those before
for _k in range(5):
    _REST = f"CAST(({_REST})::VARCHAR || substr(l, {15 * _k + 1}, 15) AS HUGEINT) % 97"
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: The operators that SQL can express; the others are tested by brute force, round trips and held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, pos, md5(substr(h, 2 * pos + 1, 800)) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS pos FROM docs WHERE n >= 400)),
often AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
starts AS (SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 400 OR lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 1 ELSE 0 END AS fresh FROM windows JOIN often USING (w)),
runs AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 400 AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM starts) GROUP BY doc_id, run),
bounds AS (SELECT doc_id, a, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM runs),
pieces AS (SELECT b.doc_id, CASE WHEN k = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * z + 1, 2 * (coalesce(next, n) - z)) AS piece, a, z FROM bounds b JOIN docs USING (doc_id)),
cut AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS rest FROM pieces GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM docs d LEFT JOIN cut USING (doc_id)""",
    "op3_ngram_jaccard_join": f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id AS id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM worded WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
nodes AS (SELECT doc_id AS id FROM documents),{_CLOSURE}
SELECT c.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id FROM components c LEFT JOIN sizes USING (id)""",
    "op5_pii": f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_OF_KIND}),
each AS (SELECT doc_id, k, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1 : len(ms)]) AS gap FROM found WHERE len(ms) > 0),
placed AS (SELECT *, CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS a, regexp_replace(m, '[^0-9]', '', 'g') AS d, CASE WHEN kind = 'iban' THEN {_LETTERS} ELSE '' END AS l FROM each WINDOW w AS (PARTITION BY doc_id, k ORDER BY i)),
good AS (SELECT doc_id, k, kind, a, kind || ':' || a || ':' || (a + length(m)) AS span FROM placed WHERE CASE kind WHEN 'ip' THEN regexp_full_match(m, '({_PART}\\.){{3}}{_PART}') WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND ({_LUHN}) % 10 = 0 WHEN 'phone' THEN length(d) BETWEEN 9 AND 15 WHEN 'iban' THEN {_REST} = 1 ELSE true END)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k, _ in _PII[:4])}, sha256(coalesce(string_agg(span, ',' ORDER BY k, a) FILTER (WHERE k < 4), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY k, a), '') AS spans FROM docs d LEFT JOIN good g ON g.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_embedding_dedup": f"""
WITH RECURSIVE vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
nodes AS (SELECT id FROM vectors),{_CLOSURE}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM components""",
}
