"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trailcast.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(job):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.drop_tables(spark)
            return job(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return job

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op1_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict (and p_block) of every page."""
    from trailcast.llm import url_filter

    model = url_filter.fit(url_filter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "p_block")


@query("op5_mixing")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, order_key, n_tokens of the mixture: no source's tokens more than 1.25 times."""
    from trailcast.llm import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, mixing.Target(max_repeats=1.25)).select("doc_id", "source", "block", "order_key", "n_tokens")


@query("op6_language_id")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    from trailcast.llm import language_id

    return language_id.held_out_predictions(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op8_html_text")
def html_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, visible text and its lengths for every page."""
    from trailcast.llm import html_text

    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                        F.when(F.col("text") != "", F.size(F.split("text", "\n"))).otherwise(0).cast("long").alias("n_lines"))


@query("op10_substring_dedup", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, j FROM (SELECT rid, unnest(range(i, i + 35)) AS j FROM rep)),
words AS (SELECT rid, w[j] AS word, j FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (
  SELECT words.rid, string_agg(word, ' ' ORDER BY words.j) AS text, count(*) AS n
  FROM words ANTI JOIN gone ON words.rid = gone.rid AND words.j = gone.j GROUP BY words.rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
""")
def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    from trailcast.llm import substring_dedup

    docs = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.regexp_replace(F.btrim(F.coalesce("kept_text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), common.SPACE, " ")
    return docs.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


@query("op3_order_minhash")
def order_minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id and whether the document stays."""
    from trailcast.llm import order_minhash

    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "class_id", "kept")


@query("op7_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    from trailcast.llm import bpe, tokenizer_files

    spec, pattern = tokenizer_files.byte_bpe()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, spec, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_cross_polytope", """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.rid AS a, b.rid AS b, b.vec_id AS other FROM ok a JOIN ok b
  ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  WITH RECURSIVE r(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM r JOIN pairs p ON r.b = p.a)
  SELECT r.a, min(v.vec_id) AS least FROM r JOIN v ON v.rid = r.b GROUP BY r.a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(reach.least, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(reach.least, v.vec_id)) AS kept
FROM v LEFT JOIN reach ON v.rid = reach.a LEFT JOIN (SELECT a, count(*) AS n FROM pairs GROUP BY a) c ON c.a = v.rid
""")
def cross_polytope_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    from trailcast.llm import cross_polytope

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return cross_polytope.link(vectors).select("vec_id", "n_links", "component_id", "kept")


@query("op2_multiprobe_ann")
def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found for each vec_id divisible by 20."""
    from trailcast.llm import pstable

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pstable.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query("op4_gated_lm")
def lm_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    from trailcast.llm import gated_lm

    return gated_lm.score_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_digest_merge", """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST)
""")
def digest_merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    from trailcast.llm import digest_merge

    return digest_merge.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _tree_sql(name: str, leaves: str, depth: int) -> str:
    """CTEs of a tree over (grp, pos, n, digest): one for each level, siblings included."""
    out = []
    for k in range(depth):
        source = leaves if k == 0 else (
            f"(SELECT grp, pos // 16 AS pos, (n + 15) // 16 AS n, sha256(string_agg(digest, '' ORDER BY pos)) AS digest "
            f"FROM {name}{k - 1} WHERE n > 1 GROUP BY ALL)")
        out.append(f"""{name}{k} AS (
  SELECT *, coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {source} WINDOW run AS (PARTITION BY grp, pos // 16 ORDER BY pos))""")
    tops = " UNION ALL ".join(f"SELECT grp, digest FROM {name}{k} WHERE n = 1" for k in range(depth))
    return ",\n".join([*out, f"{name}_top AS ({tops})"])


def _merkle_sql(documents: int = 4, sources: int = 3) -> str:
    """Twin for at most 16**(documents - 1) rows a source and 16**(sources - 1) sources."""
    joins, proof, fold = [], [], "coalesce(d.changed, d.digest)"
    levels = [("d", k, "d.grp", "d.pos") for k in range(documents)] + [("s", k, "''", "s.pos") for k in range(sources)]
    for name, k, grp, pos in levels:
        alias = f"{name}_{k}"
        if name == "s" and k == 0:
            joins.append("JOIN s0 s ON s.name = d.grp")
        joins.append(f"LEFT JOIN {name}{k} {alias} ON {alias}.n > 1 AND {alias}.grp = {grp} AND {alias}.pos = {pos} // {16 ** k}")
        proof.append(f"coalesce({alias}.l || {alias}.r, '')")
    names = [f"{name}_{k}" for name, k, _, _ in levels]
    steps = []
    for i in range(len(names)):
        l, r = f"l{i}", f"r{i}"
        steps.append(f"f{i + 1} AS (SELECT *, CASE WHEN {l} IS NULL THEN acc{i} ELSE sha256({l} || acc{i} || {r}) END AS acc{i + 1} FROM f{i})")
    sides = ", ".join(f"{a}.l AS l{i}, {a}.r AS r{i}" for i, a in enumerate(names))
    return f"""
WITH raw AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered,
    coalesce('=' || source, '') AS grp FROM documents),
part AS (
  SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head FROM raw),
leaves AS (
  SELECT grp, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS digest,
         sha256(head || strlen(lowered) || ':' || lowered) AS changed FROM part),
{_tree_sql("d", "(SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves)", documents)},
{_tree_sql("s", "(SELECT '' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM d_top)", sources)},
f0 AS (
  SELECT d.doc_id, d.digest AS leaf, s.digest AS subroot, (SELECT digest FROM s_top) AS root,
         sha256({" || ".join(proof)}) AS proof_sha256, {fold} AS acc0, {sides}
  FROM d0 d {" ".join(joins)}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, acc{len(names)} AS folded_root, acc{len(names)} = root AS verified FROM f{len(names)}
"""


@query("op11_merkle", _merkle_sql())
def merkle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    from trailcast.llm import merkle

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return merkle.manifest(docs, tampered, merkle.lower_ascii(F.col("text"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query("op12_multi_index", """
WITH r AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM r a JOIN r b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
pos AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scores n ON p.a = n.a AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
WINDOW best AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER best <= 3
""")
def hard_negative_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive."""
    from trailcast.llm import multi_index

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return multi_index.mine(vectors, F.col("vec_id") % 50 == 0)
