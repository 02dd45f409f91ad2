"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import bpe, decontaminate, dedup, idstore, licenses, pii, quality, sharding, toxicity, webp
from kinloom.llm.store import table


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.features(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_quality, op3_licenses, op4_id_store, op5_decontaminate, op6_near_dedup, op7_pii, op8_media, op9_bpe, op10_shards)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '{licenses.WORD}')"


def op3_sql() -> str:
    """Base phrases by word number, and every block held against every template."""
    quoted = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    places = ", ".join("list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) + f") AS p{n}" for n, phrase in enumerate(licenses.BASE.values()))
    templates = ", ".join(f"('{label}', {quoted(sorted(set(t.split())))})" for label, ts in licenses.TEMPLATES.items() for t in ts)
    every = " || ".join(f"p{n}" for n in range(len(licenses.BASE)))
    base = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{n}) > 0 THEN '{label}' END" for n, label in enumerate(licenses.BASE)) + "], lambda x: x IS NOT NULL))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  b0 AS (SELECT doc_id, {_words_sql('text')} AS w FROM d),
  b1 AS (SELECT doc_id, len(w) AS n_words, {places} FROM b0),
  b AS (SELECT doc_id, n_words, {every} AS places, {base} AS base FROM b1),
  l0 AS (SELECT doc_id, w, unnest(range(0, len(w), {licenses.SPAN})) AS k FROM b0),
  l AS (SELECT doc_id, k // {licenses.SPAN} AS block, list_distinct(w[k + 1:k + {2 * licenses.SPAN}]) AS own FROM l0),
  t(label, own) AS (VALUES {templates}),
  m AS (SELECT doc_id, block, label, len(list_intersect(l.own, t.own)) / len(t.own)::DOUBLE AS containment FROM l, t
    WHERE len(list_intersect(l.own, t.own)) >= {licenses.THRESHOLD} * len(t.own) - 1e-9),
  g AS (SELECT doc_id, list_distinct(list(label)) AS own, max(containment) AS best, count(DISTINCT block) AS n_blocks FROM m GROUP BY doc_id)
  SELECT b.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
    array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(g.own, []))), ',') AS labels,
    CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
  FROM b LEFT JOIN g ON b.doc_id IS NOT DISTINCT FROM g.doc_id"""


def _hits_sql(name: str, source: str, pattern: str, kind: str, rank: int, holds: str) -> str:
    """Matches of a pattern in (id, text), placed by the lengths of pieces and matches before them."""
    return f"""{name}{rank}_0 AS (SELECT id, regexp_extract_all(text, '{pattern}') AS h, regexp_split_to_array(text, '{pattern}') AS p FROM {source}),
  {name}{rank}_1 AS (SELECT id, unnest(range(len(h))) AS i, unnest(h) AS found, unnest(p[1:len(h)]) AS piece FROM {name}{rank}_0 WHERE len(h) > 0),
  {name}{rank}_2 AS (SELECT id, found, regexp_replace(found, '[^0-9]', '', 'g') AS digits, sum(length(piece) + length(found)) OVER (PARTITION BY id ORDER BY i)::BIGINT AS stop FROM {name}{rank}_1),
  {name}{rank} AS (SELECT id, stop - length(found) AS start, {rank} AS rank, stop, '{kind}' AS kind, found FROM {name}{rank}_2 WHERE {holds})"""


#: The kinds as they are written in the contract, and what a match must fulfil.
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(found, '.'), lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST('0' || ltrim(x, '0') AS BIGINT) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 1 THEN [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(digits, length(digits) - i::INT, 1) AS INT) + 1] ELSE CAST(substr(digits, length(digits) - i::INT, 1) AS INT) END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
}


def op7_sql() -> str:
    kinds = {**_PII, "secret": (pii.SECRET, "true")}
    spans = lambda name, source: ",\n  ".join(_hits_sql(name, source, p, kind, k, holds) for k, (kind, (p, holds)) in enumerate(kinds.items())) + f",\n  {name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{k}" for k in range(len(kinds))) + ")"
    written = lambda where: f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({where}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _PII) + ", " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}s" for k in ("secret", "term"))
    names = [f"n_{k}" for k in _PII] + ["n_secrets", "n_terms"]
    zero = ", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in names)
    w = pii.WINDOW
    return f"""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
  {spans("s", "d")},
  every AS (SELECT unnest(string_split(text, chr(10))) AS text FROM d),
  lines AS (SELECT text AS id, text, count(*) AS n FROM every GROUP BY text),
  {spans("x", "lines")},
  held AS (SELECT id, list(struct_pack(start := start, stop := stop, entity := kind || ':' || found)) AS sp FROM x GROUP BY id),
  bare AS (SELECT id, sp, array_to_string(list_transform(range(1, length(id) + 1), lambda i: CASE WHEN len(list_filter(sp, lambda s: s.start < i AND i <= s.stop)) > 0 THEN ' ' ELSE substr(id, i::INT, 1) END), '') AS m FROM held),
  ctx AS (SELECT id, m, unnest(sp) AS s FROM bare),
  beside AS (SELECT id, s.entity AS entity, {_words_sql('substr(m, 1, s.start::INT)')} AS b, {_words_sql('substr(m, s.stop::INT + 1)')} AS a FROM ctx),
  own AS (SELECT DISTINCT id, entity, unnest(b[greatest(1, len(b) - {w - 1}):len(b)] || a[1:{w}]) AS term FROM beside),
  e AS (SELECT entity, sum(n) AS n_e FROM (SELECT DISTINCT id, entity FROM beside) q JOIN lines USING (id) GROUP BY entity),
  pair AS (SELECT entity, term, sum(n) AS n_et FROM own JOIN lines USING (id) GROUP BY ALL),
  t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct({_words_sql('text')})) AS term FROM every) GROUP BY term),
  told AS (SELECT entity, term FROM pair JOIN t USING (term) JOIN e USING (entity) WHERE n_et * {2.0**pii.SLACK} >= n_t + 1 AND n_e < (SELECT count(*) FROM every)),
  docterm AS (SELECT DISTINCT id, term FROM s JOIN told ON told.entity = s.kind || ':' || s.found),
  chosen AS (SELECT * FROM d WHERE id IN (SELECT id FROM docterm)),
  {_hits_sql("w", "chosen", licenses.ANY_CASE, "term", 5, "true")},
  term AS (SELECT w5.* FROM w5 JOIN docterm q ON q.id = w5.id AND q.term = translate(w5.found, '{_UPPER}', '{_LOWER}') WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.id = w5.id AND s.start < w5.stop AND w5.start < s.stop)),
  whole AS (SELECT id, {counts}, {written("rank < 4")} AS base, {written("true")} AS spans FROM (SELECT * FROM s UNION ALL SELECT * FROM term) GROUP BY id)
  SELECT d.id AS doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
  FROM d LEFT JOIN whole ON whole.id = d.id"""


def oracle_sql() -> dict[str, str]:
    """The other operators draw at random, hash, train, tile or encode, which SQL can't express; tests hold them
    against brute force, round trips or held-out rows."""
    return {"op3_licenses": op3_sql(), "op7_pii": op7_sql()}
