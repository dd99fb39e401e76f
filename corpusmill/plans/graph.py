"""Queries of the link graph, grep and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import graph, grep, ranking, synonyms
from corpusmill.plans.blocks import CORPUS, QUERIES as ASK, bm25_sql, corpus, passages
from corpusmill.runtime import cut, table

NOW = "2025-01-01 00:00:00"
LEDGER = [
    {"entry": 0, "terms": ["step", "stage", "phase"], "oneway": False},
    {"entry": 1, "terms": ["reuse", "re use"], "oneway": False},
    {"entry": 2, "terms": ["claims", "asserts", "says"], "oneway": True},
    {"entry": 3, "terms": ["cache", "buffer"], "oneway": False},
]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "artifacts").select("source", "artifact_id").where("artifact_id IS NOT NULL").distinct()


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links")


def links_ref_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges extracted from records of packages: dependencies and parent."""
    rows = table(spark, sf_dir, "records").where("source = 'packages'").groupBy("source", "artifact_id").agg(F.max("surface_kind").alias("k"))
    made = rows.select("source", "artifact_id", F.array(F.concat("k", F.lit(">=1.0")), F.upper("k"), F.lit("numpy [x]"), F.col("artifact_id"), F.lit("")).alias("deps"), F.regexp_extract("artifact_id", "^([a-z]+)", 1).alias("parent"))
    return graph.default_edges(made).select("source", "artifact_id", "edge_type", "pos", "target_id")


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(_links(spark, sf_dir))


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolve(_nodes(spark, sf_dir), _links(spark, sf_dir)).select("source", "artifact_id", "edge_type", "target_source", "target_id", "node_id")


def reverse_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reverse_neighbors(_nodes(spark, sf_dir), _links(spark, sf_dir))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(_nodes(spark, sf_dir), _links(spark, sf_dir))


def walk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels up and down the tree from the hub of each source's most linked artifact."""
    edges = graph.resolve(_nodes(spark, sf_dir), _links(spark, sf_dir)).where("edge_type = 'PARENT'")
    step = edges.select(F.col("target_source").alias("source"), F.col("node_id").alias("artifact_id"), F.col("source").alias("to_source"), F.col("artifact_id").alias("to_id")).distinct()
    hubs = table(spark, sf_dir, "corpora").select(F.lit(1).cast("bigint").alias("qid"), "source", F.col("hub_id").alias("artifact_id"), F.lit(1.0).alias("score"))
    return graph.traverse(hubs, step, max_depth=2, node_budget=100_000)


def walk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walk, one query a source, ten nodes each."""
    edges = graph.resolve(_nodes(spark, sf_dir), _links(spark, sf_dir)).where("edge_type = 'PARENT'")
    step = edges.select(F.col("target_source").alias("source"), F.col("node_id").alias("artifact_id"), F.col("source").alias("to_source"), F.col("artifact_id").alias("to_id")).distinct()
    hubs = table(spark, sf_dir, "corpora").select(F.ascii("source").cast("bigint").alias("qid"), "source", F.col("hub_id").alias("artifact_id"), F.lit(1.0).alias("score"))
    return graph.traverse(hubs, step, max_depth=1, node_budget=10)


def walk_reverse_dep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What refers to the best disclosed artifact of each query, up to two steps."""
    rows = table(spark, sf_dir, "disclosures").where("artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    best = rows.groupBy("qid", "source", "artifact_id").agg(F.max("score").alias("score"))
    seeds = ranking.top(best, 1, ties=("source", "artifact_id")).drop("rank")
    return graph.reverse_dependency_walk(seeds, _nodes(spark, sf_dir), _links(spark, sf_dir), best, node_budget=100_000, fan_in_weight=0.5, proximity_weight=0.25)


def walk_collapsed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries are ranked first; only leaves of the artifacts that they route to are scored."""
    records, asked = corpus(spark, sf_dir), passages(spark, sf_dir)
    place = records.select("record_id", "source", "artifact_id", "surface_kind")
    summaries = place.where("surface_kind = 'synopsis'")
    hits = ranking.bm25(records, asked, only=summaries.select("record_id")).drop("rank").join(summaries, "record_id")
    seeds = cut(graph.tree_seeds(hits, 10))
    stored = place.where("surface_kind IN ('chunk', 'readme_chunk')").join(seeds.select("source", "artifact_id").distinct(), ["source", "artifact_id"], "left_semi")
    return graph.collapsed_tree(seeds, stored, ranking.bm25(records, asked, only=stored.select("record_id")))


def grep_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "kind")
    weight = F.when(F.col("source") == "web", 0.5).otherwise(1.0)
    return grep.grep(rows, r"falls back to an? \w+ (?:ledger|cache|queue)", id_key="doc_id", weight=weight, k=50)


def grep_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("kind <> 'web_page'").select("doc_id", "text", "updated_at")
    return grep.grep(rows, "the default", id_key="doc_id", fixed=True, at="updated_at", now=F.lit(NOW).cast("timestamp"), half_life_days=90, k=50)


def grep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).where(grep.glob_column(F.col("artifact_id"), "*/docs/*.md")).select("source", "artifact_id")


def _ledger(spark: SparkSession) -> DataFrame:
    return synonyms.ledger(spark, LEDGER)


def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synonyms.expand_queries(passages(spark, sf_dir), _ledger(spark))


def synonym_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = spark.createDataFrame([("Step",), ("re-use",), ("claims",), ("says",), ("none",)], "term string")
    table(spark, sf_dir, "benchmark")
    return synonyms.aliases(_ledger(spark), terms)


def term_regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = synonyms.term_regex("falls back")
    short = synonyms.term_regex("top k")
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).alias("n_phrase"), F.coalesce(F.col("text").rlike(short), F.lit(False)).alias("has_short"))


def keyword_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query and its words of more than nine letters as variants."""
    return synonyms.keyword_formulator(passages(spark, sf_dir), lambda t: F.filter(F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 9))


QUERIES = {
    f.__name__: f
    for f in (
        links_ref_parent, neighbors, resolved_edges, reverse_neighbors, fan_in, walk_parents, walk_budget, walk_reverse_dep, walk_collapsed_tree, grep_rank, grep_recency, grep_paths,
        synonym_expand, synonym_aliases, term_regex_match, keyword_variants,
    )
}

_NORM = "regexp_replace(lower(trim({x})), '[-_.]+', '-', 'g')"
_LINKS = f"""edges AS (SELECT source, artifact_id, edge_type, coalesce(target_source, source) AS target_source, target_id, min(pos) AS pos FROM links
    WHERE target_id IS NOT NULL AND trim(target_id) <> '' AND artifact_id IS NOT NULL GROUP BY ALL),
nodes AS (SELECT DISTINCT source, artifact_id FROM artifacts WHERE artifact_id IS NOT NULL),
loose AS (SELECT source, {_NORM.format(x="artifact_id")} AS k, min(artifact_id) AS id FROM nodes GROUP BY ALL),
resolved AS (SELECT * FROM (SELECT e.*, coalesce(n.artifact_id, CASE WHEN e.edge_type = 'REF' AND e.target_source = e.source THEN coalesce(l.id, {_NORM.format(x="e.target_id")}) ELSE e.target_id END) AS node_id FROM edges e
    LEFT JOIN nodes n ON n.source = e.target_source AND n.artifact_id = e.target_id
    LEFT JOIN loose l ON l.source = e.target_source AND l.k = {_NORM.format(x="e.target_id")})),
back AS (SELECT DISTINCT target_source AS source, node_id AS artifact_id, source AS from_source, artifact_id AS from_id FROM resolved WHERE edge_type = 'REF'),
degree AS (SELECT source, artifact_id, count(*) AS fan_in FROM back GROUP BY ALL),
down AS (SELECT DISTINCT target_source AS source, node_id AS artifact_id, source AS to_source, artifact_id AS to_id FROM resolved WHERE edge_type = 'PARENT')"""
_SWAPS = ", ".join(f"({e['entry']}, {e['terms']!r}, {str(e['oneway']).lower()})" for e in LEDGER)
_PAIRS = f"""ledger_ AS (SELECT * FROM (VALUES {_SWAPS}) v(entry, terms, oneway)),
pairs AS (SELECT entry, terms[i] AS f, i - 1 AS fp, terms[j] AS t, (j - 1)::INT AS tp FROM ledger_, LATERAL (SELECT unnest(range(1, len(terms) + 1)) AS i), LATERAL (SELECT unnest(range(1, len(terms) + 1)) AS j)
    WHERE i <> j AND (NOT oneway OR i = 1) AND trim(regexp_replace(lower(terms[i]), '[-_\\s]+', ' ', 'g')) <> trim(regexp_replace(lower(terms[j]), '[-_\\s]+', ' ', 'g')))"""

ORACLE_SQL = {
    "links_ref_parent": r"""WITH r AS (SELECT source, artifact_id, max(surface_kind) AS k FROM records WHERE source = 'packages' GROUP BY ALL),
        d AS (SELECT source, artifact_id, [k, 'numpy', regexp_extract(lower(artifact_id), '^[^<>=!~;@\[\s(,]*')] AS names FROM r),
        u AS (SELECT source, artifact_id, unnest(names) AS t, unnest(range(1, 4)) AS i FROM d),
        f AS (SELECT source, artifact_id, t, min(i) AS i FROM u WHERE t <> '' AND t <> lower(artifact_id) GROUP BY ALL)
        SELECT source, artifact_id, 'REF' AS edge_type, (row_number() OVER (PARTITION BY source, artifact_id ORDER BY i) - 1)::INT AS pos, t AS target_id FROM f
        UNION ALL SELECT source, artifact_id, 'PARENT', 0, regexp_extract(artifact_id, '^([a-z]+)', 1) FROM r WHERE regexp_extract(artifact_id, '^([a-z]+)', 1) <> ''""",
    "neighbors": f"""WITH {_LINKS}, f AS (SELECT source, artifact_id, target_source, target_id, min(pos) AS pos FROM edges GROUP BY ALL)
        SELECT source, artifact_id, target_source, target_id, row_number() OVER (PARTITION BY source, artifact_id ORDER BY pos, target_source, target_id)::INT AS place FROM f""",
    "resolved_edges": f"WITH {_LINKS} SELECT source, artifact_id, edge_type, target_source, target_id, node_id FROM resolved",
    "reverse_neighbors": f"WITH {_LINKS} SELECT * FROM back",
    "fan_in": f"WITH {_LINKS} SELECT * FROM degree",
    "walk_parents": f"""WITH {_LINKS}, l0 AS (SELECT source, hub_id AS artifact_id FROM corpora),
        l1 AS (SELECT DISTINCT to_source AS source, to_id AS artifact_id FROM l0 JOIN down USING (source, artifact_id) WHERE (to_source, to_id) NOT IN (SELECT (source, artifact_id) FROM l0)),
        l2 AS (SELECT DISTINCT to_source AS source, to_id AS artifact_id FROM l1 JOIN down USING (source, artifact_id) WHERE (to_source, to_id) NOT IN (SELECT (source, artifact_id) FROM l0 UNION SELECT (source, artifact_id) FROM l1))
        SELECT 1::BIGINT AS qid, source, artifact_id, 0 AS depth, 1.0::DOUBLE AS score FROM l0 UNION ALL SELECT 1, source, artifact_id, 1, 1.0 FROM l1 UNION ALL SELECT 1, source, artifact_id, 2, 1.0 FROM l2""",
    "walk_budget": f"""WITH {_LINKS}, l0 AS (SELECT ascii(source)::BIGINT AS qid, source, hub_id AS artifact_id FROM corpora),
        s0 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY source, artifact_id) <= 10),
        l1 AS (SELECT DISTINCT s.qid, to_source AS source, to_id AS artifact_id FROM s0 s JOIN down USING (source, artifact_id) WHERE (s.qid, to_source, to_id) NOT IN (SELECT (qid, source, artifact_id) FROM s0)),
        n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY source, artifact_id) AS k FROM l1), room AS (SELECT qid, 10 - count(*) AS room FROM s0 GROUP BY qid)
        SELECT qid, source, artifact_id, 0 AS depth, 1.0::DOUBLE AS score FROM s0 UNION ALL SELECT n.qid, source, artifact_id, 1, 1.0 FROM n JOIN room USING (qid) WHERE k <= room""",
    "walk_reverse_dep": f"""WITH {_LINKS}, best AS (SELECT qid, source, artifact_id, max(score) AS score FROM disclosures WHERE artifact_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
        l0 AS (SELECT qid, source, artifact_id FROM best QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, artifact_id) = 1),
        l1 AS (SELECT DISTINCT qid, from_source AS source, from_id AS artifact_id FROM l0 JOIN back USING (source, artifact_id) WHERE (qid, from_source, from_id) NOT IN (SELECT (qid, source, artifact_id) FROM l0)),
        l2 AS (SELECT DISTINCT qid, from_source AS source, from_id AS artifact_id FROM l1 JOIN back USING (source, artifact_id)
               WHERE (qid, from_source, from_id) NOT IN (SELECT (qid, source, artifact_id) FROM l0 UNION SELECT (qid, source, artifact_id) FROM l1)),
        w AS (SELECT *, 1 AS depth FROM l1 UNION ALL SELECT *, 2 FROM l2)
        SELECT w.qid, w.source, w.artifact_id, w.depth, round(coalesce(b.score, 0.0) + 0.5 * coalesce(d.fan_in / (SELECT max(fan_in) FROM degree)::DOUBLE, 0.0) + 0.25 / (1.0 + w.depth)::DOUBLE, 9) AS score
        FROM w LEFT JOIN best b USING (qid, source, artifact_id) LEFT JOIN degree d ON d.source = w.source AND d.artifact_id = w.artifact_id""",
    "walk_collapsed_tree": f"""WITH {CORPUS}, {ASK}, {bm25_sql(fetch=None)}, e AS (SELECT l.qid, l.record_id, l.score, c.source, c.artifact_id FROM lexical l JOIN corpus c USING (record_id) WHERE c.surface_kind = 'synopsis'),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY qid, source, artifact_id ORDER BY score DESC, record_id DESC) = 1),
        s AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, artifact_id) <= 10),
        v AS (SELECT source, artifact_id, record_id FROM corpus WHERE surface_kind IN ('chunk', 'readme_chunk')),
        r AS (SELECT s.qid, s.source, s.artifact_id, s.record_id AS self_id, s.score AS self_score, v.record_id FROM s LEFT JOIN v USING (source, artifact_id)),
        f AS (SELECT r.*, coalesce(l.score, 0.0) AS score FROM r LEFT JOIN lexical l ON l.qid = r.qid AND l.record_id = r.record_id),
        k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, record_id) AS n FROM f WHERE record_id IS NOT NULL), m AS (SELECT qid, 64 - count(*) AS room FROM s GROUP BY qid)
        SELECT k.qid, source, artifact_id, record_id, score, false AS is_summary FROM k JOIN m USING (qid) WHERE n <= room
        UNION ALL SELECT qid, source, artifact_id, self_id, self_score, true FROM f WHERE record_id IS NULL""",
    "grep_rank": r"""WITH l AS (SELECT doc_id, source, list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(13))), lambda x: regexp_matches(x, '(?i)falls back to an? \w+ (?:ledger|cache|queue)')) AS m FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, round(len(m) * CASE WHEN source = 'web' THEN 0.5 ELSE 1.0 END, 9)::DOUBLE AS score, len(m)::BIGINT AS n_lines, left(trim(m[1], E' \t\r\n'), 200) AS snippet
        FROM l WHERE len(m) > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "grep_recency": rf"""WITH l AS (SELECT doc_id, updated_at, list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, chr(13))), lambda x: contains(lower(x), 'the default')) AS m FROM documents WHERE text IS NOT NULL AND kind <> 'web_page')
        SELECT doc_id, round(len(m) * CASE WHEN updated_at IS NULL THEN 1.0 ELSE pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400e6) / 90.0) END, 9)::DOUBLE AS score,
               len(m)::BIGINT AS n_lines, left(trim(m[1], E' \t\r\n'), 200) AS snippet FROM l WHERE len(m) > 0 ORDER BY score DESC, doc_id LIMIT 50""",
    "grep_paths": f"WITH {_LINKS} SELECT source, artifact_id FROM nodes WHERE regexp_matches(artifact_id, '(?s)^.*/docs/.*\\.md$')",
    "synonym_expand": rf"""WITH {_PAIRS}, p AS (SELECT *, '(?i)(^|[^\p{{L}}\p{{N}}_])(' || array_to_string(string_split_regex(f, '[-_\s]+'), '[-_ ]?') || ')($|[^\p{{L}}\p{{N}}_])' AS re FROM pairs),
        h AS (SELECT item_id AS qid, text, p.*, min((-length(f), fp)) OVER (PARTITION BY item_id, entry) AS first FROM benchmark JOIN p ON regexp_matches(text, re)),
        m AS (SELECT qid, entry, tp, regexp_replace(text, re, '\1' || t || '\3') AS text FROM h WHERE (-length(f), fp) = first),
        o AS (SELECT m.qid, m.text, min(entry * 100 + tp) AS o FROM m JOIN benchmark b ON b.item_id = m.qid WHERE m.text <> b.text GROUP BY ALL UNION ALL SELECT item_id, text, -1 FROM benchmark)
        SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY o, text) - 1)::INT AS variant, text FROM o QUALIFY variant < 6""",
    "synonym_aliases": rf"""WITH {_PAIRS}, a AS (SELECT unnest(['Step', 're-use', 'claims', 'says', 'none']) AS term), s AS (SELECT term, trim(regexp_replace(lower(term), '[-_\s]+', ' ', 'g')) AS s FROM a),
        f AS (SELECT term, t AS alias, min(entry * 100 + tp) AS o FROM s JOIN pairs ON trim(regexp_replace(lower(f), '[-_\s]+', ' ', 'g')) = s GROUP BY ALL UNION ALL SELECT term, term, -1 FROM s)
        SELECT term, alias, row_number() OVER (PARTITION BY term ORDER BY o, alias)::INT AS place FROM f""",
    "term_regex_match": r"""SELECT doc_id, coalesce(len(regexp_extract_all(text, '(?i)falls[-_ ]?back')), 0)::INT AS n_phrase, coalesce(regexp_matches(text, '(?i)\btop[-_ ]?k\b'), false) AS has_short FROM documents""",
    "keyword_variants": r"""WITH v AS (SELECT item_id AS qid, 0 AS n, trim(text) AS text FROM benchmark UNION ALL
            SELECT item_id, unnest(range(1, len(w) + 1)), unnest(w) FROM (SELECT item_id, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: length(w) > 9) AS w FROM benchmark)),
        f AS (SELECT * FROM v WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY qid, lower(text) ORDER BY n) = 1)
        SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY n) - 1)::INT AS variant, text FROM f""",
}
