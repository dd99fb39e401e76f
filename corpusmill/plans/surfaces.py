"""Queries of decomposition, filters, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as fn
from corpusmill.operators import filters, surfaces

from corpusmill.runtime import table
from corpusmill.sources import corpus as sources

NOW = "2025-01-01 00:00:00"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current row of every artifact."""
    rows = table(spark, sf_dir, "artifacts").select("source", "artifact_id", "name", F.col("raw").alias("text"), "modified_at", "delivered_at")
    return sources.last_wins(rows.drop("delivered_at").distinct(), ["source", "artifact_id"], F.col("modified_at"))


# --- surfaces ------------------------------------------------------------------------------------


def surfaces_wholetext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surfaces.WholeText().decompose(_documents(spark, sf_dir), ["doc_id"])


def surfaces_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surfaces.Chunked().decompose(_documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", "surface_index", "surface_kind", F.sha2("text", 256).alias("digest"), F.length("text").alias("n"))


def surfaces_hard_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("flat", F.regexp_replace("text", r"\s+", " "))
    cut = docs.select("doc_id", F.posexplode(surfaces.hard_windows(F.col("flat"), 1200, 200)).alias("window_no", "piece"))
    return cut.select("doc_id", "window_no", F.sha2("piece", 256).alias("digest"))


def surfaces_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _documents(spark, sf_dir).select("doc_id", F.posexplode(surfaces.token_windows(F.regexp_replace("text", r"\s+", " "), 128, 21)).alias("window_no", "piece"))
    return cut.select("doc_id", "window_no", F.sha2("piece", 256).alias("digest"))


def balanced_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _documents(spark, sf_dir).select("doc_id", F.posexplode(surfaces.balanced_windows(F.col("text"), 1200, 200)).alias("window_no", "piece"))
    return cut.select("doc_id", "window_no", F.sha2("piece", 256).alias("digest"), F.length("piece").alias("n"))


def surfaces_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _current(spark, sf_dir)
    return surfaces.Fields(("source", "name"), layout="fields").decompose(parts, ["artifact_id"]).withColumnRenamed("artifact_id", "aid")


def surfaces_record_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surfaces.Fields(("text",), head=("name",), max_chars=600, overlap=100).decompose(_current(spark, sf_dir), ["source", "artifact_id"])
    return out.select("source", "artifact_id", "surface_index", F.sha2("text", 256).alias("digest"))


def _skill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of the skills among the documents."""
    kept = _documents(spark, sf_dir).where("kind = 'skill' AND text IS NOT NULL")
    get = lambda k: F.nullif(F.regexp_extract("text", rf"(?m)^{k}: ([^\r\n]*)", 1), F.lit(""))
    rows = kept.select("doc_id", get("name").alias("name"), get("description").alias("description"), F.coalesce("project", F.lit("none")).alias("parent"))
    return rows.where("name IS NOT NULL")


def surfaces_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = sources.skills(_skill_rows(spark, sf_dir), "doc_id")
    return source.strategy.decompose(source.items(), ["artifact_id", "parent"])


def _package_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readmes as packages: the title is the name, the first paragraph the description, REF targets the dependencies."""
    docs = _documents(spark, sf_dir).where("kind = 'readme' AND text LIKE '# %'")
    title = F.regexp_extract("text", r"^# ([^\r\n]*)", 1)
    return docs.select(
        "doc_id", title.alias("name"), F.coalesce("project", F.lit("none")).alias("parent"), F.lit("").alias("pyproject"),
        F.regexp_extract("text", r"^# [^\r\n]*\n\n([^\r\n]+)", 1).alias("setup_cfg"), F.lit(None).cast("string").alias("package_json"), F.col("text").alias("readme"),
        F.array_distinct(F.regexp_extract_all("text", F.lit(r"`([a-z]+)\."), F.lit(1))).alias("deps"),
    )


def surfaces_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = sources.packages(_package_rows(spark, sf_dir), "doc_id", exclude="^x")
    out = surfaces.Package(embed_deps=True).decompose(source.items(), ["artifact_id", "has_readme"])
    return out.select("artifact_id", "has_readme", "surface_index", "surface_kind", "text")


def tool_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).where("kind = 'tool_spec' AND text LIKE '{%'").select(F.element_at(F.split("text", "\n"), 1).alias("spec"))
    source = sources.tools(rows, check=False)
    return source.items().select("name", "description", "param_names", F.sha2(F.concat_ws("\n", "name", "description"), 256).alias("digest"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as questions and errors as answers of a user's session."""
    e = table(spark, sf_dir, "events").where("event_type IN ('view', 'error')")
    role = F.when(F.col("event_type") == "view", "user").otherwise("assistant")
    turns = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), role.alias("role"), F.col("event_id").cast("string").alias("text"), "ts")
    source = sources.sessions(turns, F.lit("2024-02-01").cast("timestamp"))
    return source.items().select("artifact_id", "session_id", "user_prompt", "assistant_summary", F.length("assistant_full").alias("n_full"))


def records_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "artifacts").select(F.col("raw").alias("text"), F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("at"), "name")
    last = sources.from_records(rows, "all", "at", id_key="name").items()
    return last.groupBy((F.col("artifact_id") == "").alias("empty")).agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("with_text"))


def report_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _current(spark, sf_dir).where("source = 'reports'").select(F.col("artifact_id").alias("path"), "text")
    kept = sources.reports(rows.where("text IS NOT NULL"), excluded=["docs_old"]).items()
    return kept.select("artifact_id", "project", "filename", F.length("text").alias("n"))


def report_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.when(F.col("doc_id") % 7 == 0, ".hidden/").when(F.col("doc_id") % 5 == 0, "node_modules/").otherwise("docs/"), F.when(F.col("doc_id") % 3 == 0, "READ_ME").otherwise(F.col("kind")), F.lit(".md"))
    return _documents(spark, sf_dir).select("doc_id", sources.report_exclusion(path).alias("reason"))


def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _current(spark, sf_dir)
    reason = F.when(fn.blank(F.col("text")), "blank")
    out = sources.coverage(found, table(spark, sf_dir, "records"), ["source", "artifact_id"], "source", reason)
    return out.withColumn("coverage_ratio", F.round("coverage_ratio", 9))


def synopsis_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _skill_rows(spark, sf_dir).withColumn("thin", surfaces.thin_description()).withColumn("text", F.col("description"))
    out = surfaces.WithSynopsis(surfaces.Skill(), gate="thin").decompose(rows, ["doc_id"])
    return out.select("doc_id", "surface_index", "surface_kind", F.length("text").alias("n"))


# --- filters -------------------------------------------------------------------------------------


def filter_eq_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"kind": "skill", "lang": {"$in": ["en", "de"]}}
    return _documents(spark, sf_dir).where(filters.compile_filter(spec)).select("doc_id")


def filter_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"$or": [{"kind": "report"}, {"$and": [{"source": "web"}, {"$not": {"lang": "en"}}]}]}
    return _documents(spark, sf_dir).where(filters.compile_filter(spec)).select("doc_id")


def filter_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"lang": {"$nin": ["en", "fr"]}, "project": {"$ne": "lumenhub"}}
    return _documents(spark, sf_dir).where(filters.compile_filter(spec)).select("doc_id")


def filter_range_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"n_chars": {"$gte": 200, "$lt": 900}, "project": {"$exists": False}}
    return _documents(spark, sf_dir).where(filters.compile_filter(spec)).select("doc_id", "n_chars")


# --- scalar functions ----------------------------------------------------------------------------


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "surfaces").select("surface_id", fn.storage_key(F.col("artifact_id"), F.col("kind"), F.col("surface_index")).alias("record_key"))
    return rows.distinct()


def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", fn.content_hash(F.col("text")).alias("plain"), fn.content_hash(F.col("text"), F.col("lang"), F.col("kind")).alias("with_fields"))


def corpus_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One short hash per project, whatever the order and repetition of its documents."""
    ids = F.array_sort(F.collect_set(F.col("doc_id").cast("string")))
    return _documents(spark, sf_dir).groupBy("project").agg(F.left(F.sha2(F.array_join(ids, "\n"), 256), F.lit(16)).alias("signature"))


def dist_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = F.concat(F.upper("surface_kind"), F.lit("_._"), F.col("artifact_id"), F.lit(" >= 1.0"))
    rows = table(spark, sf_dir, "records").select("record_id", fn.dist_name(spelt).alias("norm_name"), fn.safe_name(F.col("artifact_id")).alias("safe"), fn.slug(F.col("artifact_id")).alias("slug"))
    return rows.distinct()


def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "disclosures").select("disclosure_id", F.round(fn.sigmoid(F.col("score") * 4 - 2), 9).alias("p")).distinct()


def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.round(fn.recency(F.col("updated_at"), F.lit(NOW).cast("timestamp"), 90), 9).alias("weight"))


def pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "disclosures").select("disclosure_id", fn.pointer(F.col("pointer"), F.col("artifact_id")).alias("target")).distinct()


def phrase_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = fn.mentions(F.col("text"), F.lit("Falls  back to"))
    return _documents(spark, sf_dir).select("doc_id", hit.alias("hit"))


def fold_text_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.sha2(fn.fold_text(F.col("text")), 256).alias("digest"))


def metadata_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter fields of the artifact under those of the surface, which win where both have a key."""
    rows = table(spark, sf_dir, "surfaces").select("surface_id", "source", "kind", F.lower("granularity").alias("granularity")).distinct()
    outer = F.create_map(F.lit("source"), F.col("source"), F.lit("kind"), F.lit("artifact"), F.lit("granularity"), F.lit("whole"))
    inner = F.map_filter(F.create_map(F.lit("kind"), F.col("kind"), F.lit("granularity"), F.col("granularity")), lambda k, v: v.isNotNull())
    keep = F.map_filter(outer, lambda k, v: ~F.array_contains(F.map_keys(inner), k))
    merged = F.map_concat(keep, inner)
    return rows.select("surface_id", *(F.try_element_at(merged, F.lit(k)).alias(f"m_{k}") for k in ("source", "kind", "granularity"))).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        surfaces_wholetext, surfaces_chunked, surfaces_hard_windows, surfaces_token_windows, balanced_windows, surfaces_fields, surfaces_record_layout, surfaces_skill, surfaces_package,
        tool_records, turn_pairs, records_last_wins, report_scope, report_exclusions, coverage_report, synopsis_gated, filter_eq_in, filter_logic, filter_missing_key, filter_range_exists,
        record_ids, content_versions, corpus_signature, dist_names, sigmoid_scores, recency_decay, pointers, phrase_mentions, fold_text_full, metadata_merged,
    )
}

_STRIP = r"E' \t\r\n'"
_FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"


def _chunks_sql(rows: str, size: int, overlap: int, name: str = "pieces") -> str:
    """CTEs (of WITH RECURSIVE) that end in ``name(id, no, text)``: the texts of ``rows(id, text)`` in chunks, by one step a paragraph."""
    return rf"""whole_ AS (SELECT id, trim(text, {_STRIP}) AS t FROM {rows} WHERE text IS NOT NULL AND trim(text, {_STRIP}) <> ''),
    paras AS (SELECT id, list_filter(list_transform(string_split_regex(t, '\n\s*\n'), lambda p: trim(p, {_STRIP})), lambda p: p <> '') AS ps FROM whole_ WHERE length(t) > {size}),
    step_ AS (SELECT id, ps, 0 AS i, '' AS open_, []::VARCHAR[] AS done FROM paras
        UNION ALL SELECT id, ps, i + 1,
            CASE WHEN length(p) > {size} THEN '' WHEN open_ = '' THEN p WHEN length(open_) + 2 + length(p) > {size} THEN trim(right(open_, {overlap}) || E'\n\n' || p, {_STRIP}) ELSE open_ || E'\n\n' || p END,
            CASE WHEN length(p) > {size} THEN list_concat(CASE WHEN open_ = '' THEN done ELSE list_append(done, open_) END,
                     list_filter(list_transform(range(0, length(p), {size - overlap}), lambda k: substring(p, k + 1, {size})), lambda w: trim(w, {_STRIP}) <> ''))
                 WHEN open_ <> '' AND length(open_) + 2 + length(p) > {size} THEN list_append(done, open_) ELSE done END
        FROM (SELECT *, ps[i + 1] AS p FROM step_ WHERE i < len(ps))),
    lists_ AS (SELECT id, CASE WHEN open_ = '' THEN done ELSE list_append(done, open_) END AS l FROM step_ WHERE i = len(ps) UNION ALL SELECT id, [t] FROM whole_ WHERE length(t) <= {size}),
    {name} AS (SELECT id, unnest(range(0, len(l)))::INT AS no, unnest(l) AS text FROM lists_)"""


_CURRENT = """cur AS (SELECT source, artifact_id, name, raw AS text, modified_at FROM artifacts
    QUALIFY row_number() OVER (PARTITION BY source, artifact_id ORDER BY modified_at DESC NULLS LAST, name DESC NULLS LAST, raw DESC NULLS LAST) = 1)"""
_SKILLS = r"""skill_rows AS (SELECT * FROM (SELECT doc_id, nullif(regexp_extract(text, '(?m)^name: ([^\r\n]*)', 1), '') AS name,
    nullif(regexp_extract(text, '(?m)^description: ([^\r\n]*)', 1), '') AS description, coalesce(project, 'none') AS parent
    FROM documents WHERE kind = 'skill' AND text IS NOT NULL) WHERE name IS NOT NULL)"""

ORACLE_SQL = {
    "surfaces_chunked": f"""WITH RECURSIVE d AS (SELECT doc_id AS id, text FROM documents), {_chunks_sql("d", 1200, 200)}
        SELECT id AS doc_id, no AS surface_index, 'chunk' AS surface_kind, sha256(text) AS digest, length(text)::INT AS n FROM pieces""",
    "surfaces_wholetext": f"""SELECT doc_id, 0 AS surface_index, 'document' AS surface_kind, 'document' AS granularity, text
        FROM documents WHERE text IS NOT NULL AND trim(text, {_STRIP}) <> ''""",
    "surfaces_hard_windows": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS window_no, sha256(p) AS digest FROM (
        SELECT doc_id, i, substring(f, i + 1, 1200) AS p FROM (SELECT doc_id, {_FLAT} AS f FROM documents WHERE text IS NOT NULL AND text <> ''), LATERAL (SELECT unnest(range(0, length(f), 1000)) AS i))
        WHERE trim(p, {_STRIP}) <> ''""",
    "surfaces_token_windows": rf"""WITH w AS (SELECT doc_id, regexp_extract_all({_FLAT}, '\S+\s*') AS w FROM documents)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS window_no, sha256(p) AS digest FROM (
            SELECT doc_id, i, trim(array_to_string(list_slice(w, i, i + 127), ''), {_STRIP}) AS p FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 21) + 1, 107)) AS i) WHERE len(w) > 0)
        WHERE p <> ''""",
    "balanced_windows": f"""WITH t AS (SELECT doc_id, trim(text, {_STRIP}) AS text FROM documents), d AS (SELECT *, length(text) AS l FROM t WHERE text IS NOT NULL AND text <> ''),
        n AS (SELECT *, CASE WHEN l <= 1200 THEN 1 ELSE greatest(1, ceil((l - 200) / 1000.0)::INT) END AS n FROM d),
        w AS (SELECT *, CASE WHEN n = 1 THEN l ELSE ceil((l + (n - 1) * 200) / n::DOUBLE)::INT END AS width FROM n)
        SELECT doc_id, i::INT AS window_no, sha256(substring(text, (i * (width - CASE WHEN n = 1 THEN 0 ELSE 200 END))::INT + 1, width)) AS digest,
               length(substring(text, (i * (width - CASE WHEN n = 1 THEN 0 ELSE 200 END))::INT + 1, width))::INT AS n FROM w, LATERAL (SELECT unnest(range(0, n)) AS i)""",
    "surfaces_fields": f"""WITH {_CURRENT}, s AS (SELECT artifact_id, source, name FROM cur),
        u AS (SELECT artifact_id, source AS src, 0 AS o, 'source' AS surface_kind, trim(coalesce(source, ''), {_STRIP}) AS text FROM s
              UNION ALL SELECT artifact_id, source, 1, 'name', trim(coalesce(name, ''), {_STRIP}) FROM s)
        SELECT artifact_id AS aid, (row_number() OVER (PARTITION BY src, artifact_id ORDER BY o) - 1)::INT AS surface_index, surface_kind, 'field' AS granularity, text
        FROM u WHERE text <> ''""",
    "surfaces_record_layout": f"""WITH {_CURRENT}, c AS (SELECT source, artifact_id, trim(coalesce(name, ''), {_STRIP}) AS head, trim(coalesce(text, ''), {_STRIP}) AS body FROM cur),
        n AS (SELECT *, length(body) AS l, CASE WHEN length(body) <= 600 THEN 1 ELSE ceil((length(body) - 100) / 500.0)::INT END AS n FROM c),
        w AS (SELECT *, CASE WHEN n = 1 THEN l ELSE ceil((l + (n - 1) * 100) / n::DOUBLE)::INT END AS width, CASE WHEN n = 1 THEN 0 ELSE 100 END AS o FROM n),
        p AS (SELECT source, artifact_id, i, trim(head || chr(10) || substring(body, (i * (width - o))::INT + 1, width), {_STRIP}) AS t FROM w, LATERAL (SELECT unnest(range(0, n)) AS i))
        SELECT source, artifact_id, (row_number() OVER (PARTITION BY source, artifact_id ORDER BY i) - 1)::INT AS surface_index, sha256(t) AS digest FROM p WHERE t <> ''""",
    "surfaces_skill": f"""WITH {_SKILLS}, n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM skill_rows),
        i AS (SELECT CASE WHEN k > 1 THEN name || '@' || parent ELSE name END AS artifact_id, name, description, parent, doc_id FROM n)
        SELECT artifact_id, parent, 0 AS surface_index, 'capability' AS surface_kind, 'document' AS granularity, trim(name || E'\\n\\n' || coalesce(description, ''), {_STRIP}) AS text
        FROM i QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY doc_id DESC) = 1""",
    "surfaces_package": r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract(text, '^# ([^\r\n]*)', 1) AS name, coalesce(project, 'none') AS parent, regexp_extract(text, '^# [^\r\n]*\n\n([^\r\n]+)', 1) AS de,
               list_distinct(regexp_extract_all(text, '`([a-z]+)\.', 1)) AS un, regexp_extract_all(text, '`([a-z]+)\.', 1) AS al, trim(text) <> '' AS has_readme, left(text, 20000) AS readme FROM documents WHERE kind = 'readme' AND text LIKE '# %'),
        k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM d WHERE NOT regexp_matches(name, '^x')),
        i AS (SELECT *, CASE WHEN k > 1 THEN name || '@' || parent ELSE name END AS artifact_id, trim(de) AS description,
                     array_to_string(list_transform(list_filter(list_zip(al, range(1, len(al) + 1)), lambda z: list_position(al, z[1]) = z[2]), lambda z: z[1]), ', ') AS deps FROM k)"""
    + rf""", r AS (SELECT doc_id AS id, readme AS text FROM i), {_chunks_sql("r", 1500, 200)},
        u AS (SELECT doc_id, 0 AS o, 'description' AS surface_kind, CASE WHEN description <> '' THEN name || ': ' || description ELSE '' END AS text FROM i
              UNION ALL SELECT id, 1 + no, 'readme_chunk', text FROM pieces UNION ALL SELECT doc_id, 1000000, 'deps', CASE WHEN deps <> '' THEN 'Depends on: ' || deps ELSE '' END FROM i)
        SELECT i.artifact_id, i.has_readme, (row_number() OVER (PARTITION BY u.doc_id ORDER BY o) - 1)::INT AS surface_index, u.surface_kind, u.text
        FROM u JOIN i USING (doc_id) WHERE trim(u.text, {_STRIP}) <> ''""",
    "tool_records": r"""WITH j AS (SELECT split_part(text, E'\n', 1) AS s FROM documents WHERE kind = 'tool_spec' AND text LIKE '{%'),
        v AS (SELECT s FROM j WHERE json_valid(s) AND s->>'$.name' IS NOT NULL)
        SELECT s->>'$.name' AS name, s->>'$.description' AS description, array_to_string(list_sort(json_keys(s, '$.parameters')), ',') AS param_names,
               sha256((s->>'$.name') || E'\n' || (s->>'$.description')) AS digest FROM v""",
    "turn_pairs": """WITH t AS (SELECT user_id AS s, event_id AS turn, event_type, ts FROM events WHERE event_type IN ('view', 'error')),
        r AS (SELECT s, max(ts) AS last FROM t GROUP BY s HAVING max(ts) >= TIMESTAMP '2024-02-01' - INTERVAL 90 DAYS),
        n AS (SELECT t.*, count(CASE WHEN event_type = 'view' THEN 1 END) OVER (PARTITION BY t.s ORDER BY turn) AS pair FROM t JOIN r ON r.s = t.s),
        g AS (SELECT s, pair, max(CASE WHEN event_type = 'view' THEN turn::VARCHAR END) AS q, max(CASE WHEN event_type = 'error' THEN turn END)::VARCHAR AS a,
                     coalesce(string_agg(CASE WHEN event_type = 'error' THEN turn::VARCHAR END, E'\\n\\n' ORDER BY turn), '') AS f FROM n WHERE pair > 0 GROUP BY s, pair)
        SELECT s || '#' || pair AS artifact_id, s::VARCHAR AS session_id, q AS user_prompt, a AS assistant_summary, length(f)::INT AS n_full FROM g""",
    "records_last_wins": """WITH r AS (SELECT coalesce(nullif(name, ''), 'all_' || epoch_us(delivered_at)) AS id, raw, epoch_us(delivered_at) AS t, artifact_id FROM artifacts)
        SELECT id = '' AS empty, count(*) AS n, count(raw) AS with_text FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY t DESC, raw DESC NULLS LAST) = 1) GROUP BY 1""",
    "report_scope": f"""WITH {_CURRENT} SELECT artifact_id, split_part(artifact_id, '/', 1) AS project, split_part(artifact_id, '/', -1) AS filename, length(text)::INT AS n FROM cur
        WHERE source = 'reports' AND text IS NOT NULL AND trim(text) <> '' AND regexp_matches(artifact_id, '(?:^|/)(?:misc/)?docs/(?:[^/]+/)*[^/]+\\.md$')
          AND NOT regexp_matches(regexp_replace(split_part(artifact_id, '/', -1), '\\.md$', ''), '^[^a-z]*[A-Z][^a-z]*$') AND NOT regexp_matches(artifact_id, '(?:^|/)(?:docs_old|\\.[^/]*)/')""",
    "report_exclusions": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'allcaps' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'excluded_dir' END AS reason FROM documents""",
    "coverage_report": rf"""WITH {_CURRENT}, h AS (SELECT DISTINCT source, artifact_id FROM records),
        s AS (SELECT c.source, CASE WHEN c.text IS NULL OR trim(c.text, {_STRIP}) = '' THEN 'excluded' WHEN h.source IS NOT NULL THEN 'indexed' ELSE 'missing' END AS st
              FROM cur c LEFT JOIN h ON h.source = c.source AND h.artifact_id = c.artifact_id),
        a AS (SELECT source, count(*) FILTER (st = 'indexed') AS indexed, count(*) FILTER (st = 'missing') AS missing, count(*) FILTER (st = 'excluded') AS excluded FROM s GROUP BY source)
        SELECT *, round(CASE WHEN indexed + missing > 0 THEN indexed::DOUBLE / (indexed + missing) ELSE 1.0 END, 9) AS coverage_ratio FROM a""",
    "synopsis_gated": rf"""WITH {_SKILLS}, t AS (SELECT doc_id, trim(coalesce(description, ''), {_STRIP}) AS d, trim(name || E'\n\n' || coalesce(description, ''), {_STRIP}) AS cap FROM skill_rows),
        s AS (SELECT *, CASE WHEN length(d) < 40 THEN left(coalesce(nullif(regexp_extract(d, '^(.*?[.!?])(?:\s|$)', 1), ''), d), 240) ELSE '' END AS syn FROM t),
        u AS (SELECT doc_id, 0 AS o, 'synopsis' AS surface_kind, syn AS x FROM s UNION ALL SELECT doc_id, 1, 'capability', cap FROM s)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1)::INT AS surface_index, surface_kind, length(x)::INT AS n FROM u WHERE trim(x, {_STRIP}) <> ''""",
    "filter_eq_in": "SELECT doc_id FROM documents WHERE kind = 'skill' AND lang IN ('en', 'de')",
    "filter_logic": "SELECT doc_id FROM documents WHERE kind = 'report' OR (source = 'web' AND lang IS DISTINCT FROM 'en')",
    "filter_missing_key": "SELECT doc_id FROM documents WHERE coalesce(lang NOT IN ('en', 'fr'), true) AND project IS DISTINCT FROM 'lumenhub'",
    "filter_range_exists": "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND n_chars < 900 AND project IS NULL",
    "record_ids": "SELECT DISTINCT surface_id, left(sha256(artifact_id || chr(31) || kind || chr(31) || surface_index), 24) AS record_key FROM surfaces",
    "content_versions": "SELECT doc_id, sha256(text) AS plain, sha256(coalesce(text, '') || chr(31) || coalesce(lang, '') || chr(31) || coalesce(kind, '')) AS with_fields FROM documents",
    "corpus_signature": "SELECT project, left(sha256(string_agg(DISTINCT doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 16) AS signature FROM documents GROUP BY project",
    "dist_names": r"""SELECT DISTINCT record_id, regexp_replace(lower(regexp_extract(trim(upper(surface_kind) || '_._' || artifact_id || ' >= 1.0'), '^[^<>=!~;@\[\s(,]*')), '[-_.]+', '-', 'g') AS norm_name,
        regexp_replace(artifact_id, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, regexp_replace(regexp_replace(lower(artifact_id), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM records""",
    "sigmoid_scores": "SELECT DISTINCT disclosure_id, round(CASE WHEN score IS NULL OR isnan(score) THEN 0.0 ELSE 1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, score * 4 - 2)))) END, 9)::DOUBLE AS p FROM disclosures",
    "recency_decay": f"SELECT doc_id, round(CASE WHEN updated_at IS NULL THEN 1.0 ELSE pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 86400e6) / 90.0) END, 9) AS weight FROM documents",
    "pointers": "SELECT DISTINCT disclosure_id, coalesce(nullif(pointer, ''), nullif(artifact_id, '')) AS target FROM disclosures",
    "phrase_mentions": r"""SELECT doc_id, coalesce(regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])falls\s+back\s+to(?:$|[^\p{L}\p{N}_])'), false) AS hit FROM documents""",
    "metadata_merged": "SELECT DISTINCT surface_id, source AS m_source, coalesce(kind, 'artifact') AS m_kind, coalesce(lower(granularity), 'whole') AS m_granularity FROM surfaces",
}

