"""The thin opN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import held_out, table
from panelwright.llm.cover_tree import near_vectors
from panelwright.llm.jaccard_join import jaccard_classes
from panelwright.llm.language_id import predict_language, train_language
from panelwright.llm.mixing import form_topic, mix_sources
from panelwright.llm.packing import pack_documents
from panelwright.llm.pii import find_pii
from panelwright.llm.quality_mcd import quality_outliers
from panelwright.llm.token_files import read_token_files, write_token_files
from panelwright.llm.toxic_crf import tag_toxic, train_toxic
from panelwright.llm.url_rules import Rule, judge_urls


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The rules of the URL query.
URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(table(spark, sf_dir, "documents"))


def op2_toxic_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and spans: start:end of each toxic span in code points, comma-joined."""
    docs = table(spark, sf_dir, "documents")
    found = tag_toxic(docs, train_toxic(docs, table(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", spans.alias("spans"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs, train_language(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, the cell's weight, the document's probability, and whether it is kept."""
    found = mix_sources(table(spark, sf_dir, "documents"), form_topic(F.col("text")))
    names = {"mix_source": "source", "mix_lang": "lang", "mix_topic": "topic", "mix_tokens": "n_tokens", "mix_weight": "weight", "mix_probability": "probability", "mix_kept": "kept"}
    return found.select("doc_id", *[F.col(k).alias(v) for k, v in names.items()])


def op7_pii_lstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mcd": op1_quality_mcd,
    "op2_toxic_crf": op2_toxic_crf,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_url_rules": op5_url_rules,
    "op6_raking": op6_raking,
    "op7_pii_lstm_crf": op7_pii_lstm_crf,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_cover_tree": op10_cover_tree,
}
_HOST_PATH = """SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)"""
ORACLE_SQL: dict[str, str] = {
    "op5_url_rules": f"""WITH rules(verdict, h, p) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}), urls AS ({_HOST_PATH}),
      fits AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1, 2, 3)
      SELECT u.page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id""",
    "op8_jaccard_join": r"""WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
      sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM docs),
      sized AS (SELECT doc_id, len(s) AS n FROM sets), cells AS (SELECT doc_id, hash(unnest(s)) AS g FROM sets),
      shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM cells a JOIN cells b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
      half AS (SELECT x, y FROM shared JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)), links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
      reach(x, y) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
      SELECT s.doc_id, CAST(any_value(s.n) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM sized s JOIN reach r ON r.x = s.doc_id GROUP BY 1""",
    "op10_cover_tree": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
      reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
      parts AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1), degrees AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
      SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM parts LEFT JOIN degrees USING (vec_id)""",
}
