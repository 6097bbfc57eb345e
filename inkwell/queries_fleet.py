"""Queries over collections of files, with their SQL: both read the texts of the same views (sources/views.py)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import fixed, snippets
from inkwell.operators import fleet, identity
from inkwell.sources import adapters as ad
from inkwell.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FILES = "files AS (" + views.FILES.format(supplier="supplier") + ")"
_SETTINGS = "settings AS (" + views.SETTINGS.format(supplier="supplier") + ")"
_MAPPED = "mapped AS (" + views.MAPPED.format(supplier="supplier") + ")"


def query(sql: str | None) -> Callable:
    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return named


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.FILES, "supplier")


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.SETTINGS, "supplier")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    return views.view(spark, sf, views.MAPPED, "supplier")


def _light(name: str, red: str, yellow: str) -> str:
    return f"SELECT collection, '{name}' AS \"check\", CASE WHEN {red} THEN 'RED' WHEN {yellow} THEN 'YELLOW' ELSE 'GREEN' END AS status FROM d"


_CHECKS = f"""d AS (SELECT collection,
 max(CASE WHEN rel_path = 'guide_qa.yaml' THEN CAST(text LIKE '%guide:%' AS INT) + CAST(text LIKE '%los:%' AS INT) + CAST(text LIKE '%metrics:%' AS INT) + CAST(text LIKE '%readiness_checks:%' AS INT) END) AS sections,
 max(CASE WHEN rel_path = 'Makefile' THEN CASE WHEN text LIKE '%include $(TOOLING)%' THEN 9 ELSE len(regexp_extract_all(text, 'qa-(health|refs|los|cards|presentation):')) END END) AS targets,
 max(CASE WHEN rel_path LIKE '%extensions.sty' THEN CASE WHEN contains(text, chr(92) || 'interviewmargin') AND contains(text, chr(92) || 'formulamargin') THEN 2 ELSE 1 END END) AS style,
 max(CASE WHEN rel_path = 'cards/all_cards.yml' THEN size END) AS cards, count(*) FILTER (WHERE rel_path LIKE 'decks/%.apkg') AS decks, count(*) FILTER (WHERE rel_path = 'review/dashboard.md') AS dashboard,
 count(*) FILTER (WHERE rel_path IN ('Makefile', 'guide_qa.yaml') AND contains(text, '~/Claude/')) + count(*) FILTER (WHERE rel_path = 'guide_qa.yaml' AND contains(text, 'mdls') AND NOT contains(text, 'pdfinfo'))
 + count(*) FILTER (WHERE rel_path = 'guide_qa.yaml' AND regexp_matches(text, 'scripts/validation/\\w+\\.py')) AS problems FROM files GROUP BY collection),
checks AS ({_light("configuration", "sections IS NULL", "sections < 4")} UNION ALL {_light("build_targets", "COALESCE(targets, 0) = 0", "targets < 5")} UNION ALL {_light("style_macros", "style IS NULL", "style < 2")}
 UNION ALL {_light("cards", "cards IS NULL", "cards < 100")} UNION ALL {_light("decks", "decks = 0", "false")} UNION ALL {_light("dashboard", "dashboard = 0", "false")} UNION ALL {_light("portable_paths", "problems > 0", "false")})"""


@query(f"WITH {_FILES}, {_CHECKS} SELECT * FROM checks")
def collection_file_checks(spark, sf):
    return fleet.file_checks(_files(spark, sf))


@query(f"""WITH {_FILES}, p AS (
 SELECT collection, 1 AS k, 'Makefile home path' AS label FROM files WHERE rel_path = 'Makefile' AND contains(text, '~/Claude/') UNION ALL SELECT collection, 2, 'configuration home path' FROM files WHERE rel_path = 'guide_qa.yaml' AND contains(text, '~/Claude/')
 UNION ALL SELECT collection, 3, 'configuration mdls' FROM files WHERE rel_path = 'guide_qa.yaml' AND contains(text, 'mdls') AND NOT contains(text, 'pdfinfo') UNION ALL SELECT collection, 4, 'configuration scripts path' FROM files WHERE rel_path = 'guide_qa.yaml' AND regexp_matches(text, 'scripts/validation/\\w+\\.py'))
 SELECT collection, string_agg(label, '; ' ORDER BY k) AS problems FROM p GROUP BY collection""")
def collection_path_problems(spark, sf):
    d = fleet.path_problems(_files(spark, sf)).where(F.size("problems") > 0)
    return d.select("collection", F.array_join("problems", "; ").alias("problems"))


@query("SELECT o_custkey AS collection, count(DISTINCT o_orderdate) AS n_levels, CASE WHEN count(DISTINCT o_orderdate) <= 12 THEN 'GREEN' WHEN count(DISTINCT o_orderdate) <= 20 THEN 'YELLOW' ELSE 'RED' END AS status FROM orders GROUP BY 1")
def collection_level_checks(spark, sf):
    return fleet.level_checks(ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderdate").alias("level")))


_CHAPTERS = "c AS (SELECT collection, count(DISTINCT CASE WHEN rel_path NOT SIMILAR TO 'chapters/[A-F]_.*' AND CAST(regexp_extract(rel_path, '^chapters/(\\d+)', 1) AS INT) <> 0 THEN rel_path END) AS n_chapters FROM files WHERE rel_path LIKE 'chapters/%.tex' AND (rel_path SIMILAR TO 'chapters/[A-F]_.*' OR regexp_matches(rel_path, '^chapters/\\d')) GROUP BY collection)"
_CHAPTERS = _CHAPTERS.replace("CAST(regexp_extract(rel_path, '^chapters/(\\d+)', 1) AS INT)", "TRY_CAST(regexp_extract(rel_path, '^chapters/(\\d+)', 1) AS INT)")


@query(f"WITH {_FILES}, {_CHAPTERS} SELECT * FROM c")
def content_chapter_counts(spark, sf):
    return fleet.chapter_counts(_files(spark, sf))


_MISSING = """mods AS (SELECT DISTINCT collection, regexp_extract(rel_path, '_(m\\d+)_', 1) AS module FROM files WHERE regexp_matches(rel_path, '^chapters/.*_m\\d+_')),
 missing AS (SELECT collection, string_agg(module, ',' ORDER BY CAST(substr(module, 2) AS INT)) AS missing FROM mods WHERE NOT EXISTS (SELECT 1 FROM mapped WHERE mapped.collection = mods.collection AND mapped.module = mods.module) GROUP BY collection)"""


@query(f"WITH {_FILES}, {_MAPPED}, {_MISSING} SELECT * FROM missing")
def modules_not_mapped(spark, sf):
    return fleet.missing_modules(_files(spark, sf), _mapped(spark, sf))


@query(f"""WITH {_FILES}, {_SETTINGS}, {_MAPPED}, {_MISSING}, {_CHAPTERS},
 k AS (SELECT collection, count(*) FILTER (WHERE rel_path LIKE 'decks/%' AND lower(rel_path) LIKE '%complete%') AS complete, count(*) FILTER (WHERE rel_path LIKE 'decks/%' AND lower(rel_path) NOT LIKE '%complete%') AS single FROM files GROUP BY collection),
 j AS (SELECT s.collection, complete, single, greatest(2, COALESCE(n_chapters, 0) - 1) AS need, missing, (SELECT count(*) FROM mapped WHERE mapped.collection = s.collection) AS entries, lower(trim(COALESCE(decks_complete_only, ''))) = 'true' AND length(trim(justification)) > 0 AS waived
  FROM settings s LEFT JOIN k USING (collection) LEFT JOIN c USING (collection) LEFT JOIN missing USING (collection)),
 r AS (SELECT collection, concat_ws('; ', CASE WHEN complete = 0 THEN 'no complete deck' END, CASE WHEN entries = 0 THEN 'empty map' WHEN missing IS NOT NULL THEN 'missing modules ' || missing END, CASE WHEN NOT waived AND single < need THEN single || '/' || need || ' decks' END) AS reason FROM j)
 SELECT collection, reason = '' AS passed, reason FROM r""")
def deck_gate(spark, sf):
    return fleet.deck_gate(_files(spark, sf), _settings(spark, sf), _mapped(spark, sf))


@query(f"""WITH {_FILES}, {_SETTINGS}, r AS (SELECT collection, sum(len(regexp_extract_all(text, '\\[\\s*R\\s*\\]'))) AS red FROM files WHERE rel_path = 'review/dashboard.md' GROUP BY collection)
 SELECT s.collection, CAST(red AS BIGINT) AS red, red IS NOT NULL AND (red = 0 OR (COALESCE(red_waiver, '') = 'true' AND trim(red_justification) <> '')) AS passed,
 CASE WHEN red IS NULL THEN 'missing' WHEN red = 0 THEN '' WHEN COALESCE(red_waiver, '') = 'true' AND trim(red_justification) <> '' THEN 'waived' WHEN red_waiver = 'true' THEN 'no justification' ELSE 'red' END AS reason FROM settings s LEFT JOIN r USING (collection)""")
def dashboard_gate(spark, sf):
    return fleet.dashboard_gate(_files(spark, sf), _settings(spark, sf))


@query(f"""WITH {_FILES}, l AS (SELECT collection, arg_max(text, rel_path) AS text FROM files WHERE rel_path LIKE 'review/gold_audit_%' GROUP BY collection),
 r AS (SELECT collection, CASE WHEN contains(text, 'Subsequent revisions may deepen') OR regexp_extract(text, '\\*\\*Guide\\*\\*:\\s*`[^`]+`\\s*\\([^,]*,\\s*([^)]+)\\)', 1) = 'TBV' THEN 'scaffold' WHEN len(regexp_extract_all(text, '\\S+')) < 500 THEN 'short'
 WHEN len(regexp_extract_all(text, '(?i)(book\\s*§|Ch\\.?\\s*\\d+|Chapter\\s*\\d+|Figure\\s*\\d+|Table\\s*\\d+|p\\.\\s*\\d+)')) < 3 THEN 'thin_citations' WHEN NOT regexp_matches(text, '(?i)E/F\\s+source\\s+verification') THEN 'no_section' ELSE 'pass' END AS reason FROM l)
 SELECT collection, reason = 'pass' AS passed, reason FROM r""")
def fidelity_gate(spark, sf):
    return fleet.fidelity_gate(_files(spark, sf))


_STUBS = """t AS (SELECT collection, sum(CASE WHEN text IS NULL THEN 0 ELSE 1 END) AS items, sum(CASE WHEN text IS NULL THEN 0 WHEN len(list_filter(string_split_regex(regexp_extract(text, 'item\\[L-1\\.\\d\\]([^\\\\]*)', 1), '\\s+'), lambda w: length(w) > 1)) < 10 THEN 1 ELSE 0 END) AS stubs, count(*) FILTER (WHERE text IS NULL) AS unreadable
 FROM files WHERE rel_path LIKE 'chapters/%' GROUP BY collection)"""


@query(f"WITH {_FILES}, {_STUBS} SELECT collection, CAST(items AS BIGINT) AS items, CAST(stubs AS BIGINT) AS stubs, CAST(unreadable AS BIGINT) AS unreadable FROM t")
def checkpoint_stubs(spark, sf):
    return fleet.stub_items(_files(spark, sf))


@query(f"WITH {_FILES}, {_STUBS}, s AS (SELECT s_suppkey AS collection, s_suppkey % 3 + 7 AS tested, 8 AS defined FROM supplier) SELECT s.collection, tested >= defined AND COALESCE(stubs, 0) = 0 AND COALESCE(unreadable, 0) = 0 AS passed, CAST(COALESCE(stubs, 0) AS BIGINT) AS stubs FROM s LEFT JOIN t USING (collection)")
def retrieval_gate(spark, sf):
    coverage = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("collection"), (F.col("s_suppkey") % 3 + 7).alias("tested"), F.lit(8).alias("defined"))
    return fleet.retrieval_gate(coverage, _files(spark, sf))


@query("""WITH v AS (SELECT ps.s_suppkey AS collection, 'audit ' || n_nationkey AS audit, CASE WHEN (s_suppkey * n_nationkey) % 41 = 40 THEN 1 ELSE 0 END AS exit_code, 'ok' || chr(10) || CASE WHEN (s_suppkey + n_nationkey) % 47 = 0 THEN 'FAIL: x' ELSE 'no FAIL' END AS output, n_nationkey <> 3 OR s_suppkey % 10 <> 0 AS in_scope FROM supplier ps JOIN nation ON n_nationkey < 13),
 b AS (SELECT *, NOT in_scope OR exit_code <> 0 OR contains(output, chr(10) || 'FAIL') AS bad FROM v)
 SELECT collection, count(*) FILTER (WHERE bad) = 0 AS passed, count(*) FILTER (WHERE bad) AS failing, COALESCE(array_to_string(list_slice(list_sort(list(audit) FILTER (WHERE bad)), 1, 3), '; '), '') AS "first" FROM b GROUP BY collection""")
def audit_gate(spark, sf):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    d = ad.table(spark, sf, "supplier").join(ad.table(spark, sf, "nation"), n < 13)
    output = F.concat(F.lit("ok\n"), F.when((k + n) % 47 == 0, "FAIL: x").otherwise("no FAIL"))
    return fleet.audit_gate(d.select(k.alias("collection"), F.concat(F.lit("audit "), n.cast("string")).alias("audit"), F.when(k * n % 41 == 40, 1).otherwise(0).alias("exit_code"), output.alias("output"), ((n != 3) | (k % 10 != 0)).alias("in_scope")))


_SILVER = f"""g AS (SELECT collection, count(*) FILTER (WHERE status = 'GREEN') AS green FROM checks GROUP BY collection),
 f AS (SELECT collection, min(CASE WHEN NOT passed THEN place END) AS place FROM gates GROUP BY collection),
 silver AS (SELECT g.collection, green, CASE WHEN green < 5 THEN 'FAIL' WHEN f.place IS NULL THEN 'PASS' WHEN f.place = 1 AND gates.reason = 'missing' THEN 'MISSING' ELSE 'FAIL' END AS status, CASE WHEN green >= 5 THEN COALESCE(gates.gate || ': ' || gates.reason, '') END AS detail
 FROM g LEFT JOIN f USING (collection) LEFT JOIN gates ON gates.collection = f.collection AND gates.place = f.place)"""
_GATE_ROWS = "gates AS (SELECT s_suppkey AS collection, i AS place, 'gate ' || i AS gate, (s_suppkey * i) % 5 <> 1 AS passed, CASE WHEN s_suppkey % 2 = 0 THEN 'missing' ELSE 'thin' END AS reason FROM supplier, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) n)"


@query(f"WITH {_FILES}, {_CHECKS}, {_GATE_ROWS}, {_SILVER} SELECT collection, green, status, detail FROM silver")
def collection_classes(spark, sf):
    k = F.col("s_suppkey")
    rows = ad.table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(*(F.lit(i) for i in range(1, 5)))).alias("i"))
    rows = rows.select(k.alias("collection"), F.col("i").alias("place"), F.concat(F.lit("gate "), F.col("i").cast("string")).alias("gate"), (k * F.col("i") % 5 != 1).alias("passed"), F.when(k % 2 == 0, "missing").otherwise("thin").alias("reason"))
    return fleet.ranked(fleet.first_class(fleet.file_checks(_files(spark, sf)), rows, 5))


@query("SELECT max(CASE WHEN c_mktsegment IN ('FAIL', 'MACHINERY') THEN 1 ELSE 0 END) AS exit_code FROM customer")
def fleet_exit(spark, sf):
    return fleet.fleet_exit(ad.table(spark, sf, "customer").select(F.when(F.col("c_mktsegment") == "MACHINERY", "SCAFFOLD-ONLY").otherwise("PASS").alias("class")))


def _counted(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(COALESCE(text, ''), '{pattern}')) AS BIGINT)"


_METRICS = "m AS (SELECT collection, rel_path, CAST(len(string_split(COALESCE(text, ''), chr(10))) AS INT) AS n_lines, " + ", ".join(f"{_counted(p)} AS {k}" for k, p in fixed.CONTENT_COUNTS.items()) + " FROM files WHERE rel_path LIKE 'chapters/%')"


@query(f"WITH {_FILES}, {_METRICS} SELECT * FROM m")
def content_metrics(spark, sf):
    return fleet.content_metrics(_files(spark, sf))


@query(f"""WITH {_FILES}, {_SETTINGS}, {_METRICS}, s AS (SELECT collection, sum(margins) / count(*) AS a, sum(keyconcepts) / count(*) AS b, sum(problems) AS p, sum(vignettes) AS v FROM m GROUP BY collection),
 l AS (SELECT collection, CASE WHEN a >= CASE WHEN profile = 'aws_cert' THEN 4 ELSE 8 END THEN 0 WHEN a >= CASE WHEN profile = 'aws_cert' THEN 2 ELSE 4 END THEN 1 ELSE 2 END AS m, CASE WHEN b >= 2 THEN 0 WHEN b >= 1 THEN 1 ELSE 2 END AS k, CASE WHEN p >= 15 THEN 0 WHEN p >= 7.5 THEN 1 ELSE 2 END AS p, CASE WHEN v >= 3 THEN 0 WHEN v >= 1 THEN 1 ELSE 2 END AS v FROM settings JOIN s USING (collection))
 SELECT collection, (['GREEN', 'YELLOW', 'RED'])[m + 1] AS margin, (['GREEN', 'YELLOW', 'RED'])[k + 1] AS keyconcept, (['GREEN', 'YELLOW', 'RED'])[p + 1] AS problem, (['GREEN', 'YELLOW', 'RED'])[v + 1] AS vignette, (['GREEN', 'YELLOW', 'RED'])[greatest(m, k, p, v) + 1] AS overall FROM l""")
def content_lights(spark, sf):
    return fleet.content_lights(fleet.content_metrics(_files(spark, sf)), _settings(spark, sf).select("collection", "profile"))


_CLASSES = "notes AS (" + views.NOTES.format(part="part") + "), labels_ AS (" + views.LABELS.format(part="part") + """),
 r AS (SELECT collection, note_id, note, regexp_extract_all(COALESCE(note, ''), '\\\\ref\\{([^}]+)\\}', 1) AS refs, list_filter(regexp_extract_all(COALESCE(note, ''), '\\b(\\w+)\\b', 1), lambda w: list_contains(sizes, w) AND w <> CAST(collection AS STRING)) AS others FROM notes, (SELECT list(DISTINCT CAST(p_size AS STRING)) AS sizes FROM part)),
 known AS (SELECT collection, list(DISTINCT label) AS labels FROM labels_ GROUP BY collection),
 b AS (SELECT r.*, list_filter(refs, lambda x: NOT list_contains(labels, x))[1] AS bad, regexp_extract(COALESCE(note, ''), '(?i)\\bvol\\d+\\b|\\bvol[\\s_]\\w+\\b') AS vol, COALESCE(note, '') LIKE 'see Module%' AS inner_ FROM r LEFT JOIN known USING (collection)),
 classes AS (SELECT collection, note_id, CASE WHEN len(refs) > 0 THEN 'internal' WHEN len(others) > 0 THEN 'external_collection' WHEN vol <> '' THEN 'external_volume' WHEN inner_ THEN 'internal' ELSE 'unresolved' END AS kind,
 CASE WHEN len(refs) > 0 THEN COALESCE(bad, array_to_string(refs, ',')) WHEN len(others) > 0 THEN others[1] WHEN vol <> '' THEN vol ELSE substr(COALESCE(note, ''), 1, 60) END AS target, bad IS NULL AS valid FROM b)"""


def _classes(spark, sf):
    notes, labels = views.view(spark, sf, views.NOTES, "part"), views.view(spark, sf, views.LABELS, "part")
    return fleet.reference_classes(notes, labels, ad.table(spark, sf, "part").select(F.col("p_size").alias("collection")).distinct())


@query(f"WITH {_CLASSES} SELECT * FROM classes")
def reference_classes(spark, sf):
    return _classes(spark, sf)


@query(f"WITH {_CLASSES} SELECT collection, kind, count(*) AS n, count(*) FILTER (WHERE NOT valid) AS broken FROM classes GROUP BY ALL")
def reference_tallies(spark, sf):
    return fleet.reference_tallies(_classes(spark, sf))


_LISTINGS = """l AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'def f():' || chr(10) || ' return 1' WHEN 1 THEN 'select a from t where x' WHEN 2 THEN 'MATCH (a)-[:R]->(b)' WHEN 3 THEN chr(123) || '"a" : 1' || chr(125) WHEN 4 THEN 'a: 1' || chr(10) || 'b: 2' || chr(10) || 'c-d: 3'
 WHEN 5 THEN '$ ls -l' WHEN 6 THEN '  ' WHEN 7 THEN 'x = foo' || chr(10) || 'print x' END AS listing, text FROM {documents}), t AS (SELECT doc_id, COALESCE(listing, text) AS listing FROM l)"""


@query("WITH " + _LISTINGS.format(documents="documents") + """ SELECT doc_id, CASE WHEN trim(listing) = '' THEN NULL WHEN regexp_matches(listing, '\\b(def|class|import|from\\s+\\w+\\s+import|async\\s+def|lambda|elif|@\\w+)\\b') THEN 'python'
 WHEN regexp_matches(listing, '(?m)^\\s*[a-zA-Z_]\\w*\\s*[:=]\\s*[A-Za-z\\[\\(]') AND regexp_matches(listing, '(?m)^\\s*(return|print|self\\.|def\\s)') THEN 'python'
 WHEN regexp_matches(listing, '(?i)\\b(SELECT|FROM|WHERE|JOIN|GROUP BY|ORDER BY)\\b') AND regexp_matches(trim(listing), '(?i);\\s*$|\\bFROM\\s+\\w+|\\bWHERE\\s+\\w+') THEN 'sql' WHEN regexp_matches(listing, 'MATCH\\s*\\(.*?\\)-\\[:\\w+\\]->') OR regexp_matches(listing, '\\b(MATCH|RETURN|CREATE|MERGE)\\b\\s*\\(') THEN 'cypher'
 WHEN regexp_matches(listing, '^\\s*[\\{\\[]') AND regexp_matches(listing, '"\\w+"\\s*:') THEN 'json' WHEN len(regexp_extract_all(trim(listing), '(?m)^[a-zA-Z_][\\w-]*\\s*:\\s*\\S')) >= 3 THEN 'yaml'
 WHEN regexp_matches(listing, '(?m)^\\s*\\$\\s+\\w+|^\\s*>>>\\s+') OR regexp_matches(listing, '\\b(pip\\s+install|npm\\s+install|git\\s+\\w+|curl\\s+|cd\\s+)') THEN 'bash' END AS language FROM t""")
def code_languages(spark, sf):
    d = spark.sql("WITH " + _LISTINGS + " SELECT * FROM t", documents=ad.table(spark, sf, "documents"))
    return d.select("doc_id", snippets.code_language("listing").alias("language"))


@query("SELECT p_partkey AS doc, CASE WHEN NOT regexp_matches(id, '^([A-Z0-9]+(?:-[A-Z0-9]+)?)-(\\d+)\\.(\\d+)$') THEN 'format' WHEN level NOT IN (" + ", ".join(f"'{x}'" for x in fixed.OUTCOME_LEVELS) + ") THEN 'level' END AS fault FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'PY-' || p_size || '.1' WHEN p_size % 3 = 1 THEN p_brand ELSE 'DS-PD-8.' || p_size END AS id, CASE WHEN p_partkey % 2 = 0 THEN 'explain' ELSE lower(p_type) END AS level FROM part)")
def outcome_faults(spark, sf):
    size = F.col("p_size")
    los = F.when(size % 3 == 0, F.concat(F.lit("PY-"), size.cast("string"), F.lit(".1"))).when(size % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("DS-PD-8."), size.cast("string")))
    level = F.when(F.col("p_partkey") % 2 == 0, "Explain").otherwise(F.col("p_type"))
    return ad.table(spark, sf, "part").select(F.col("p_partkey").alias("doc"), los.alias("id"), level.alias("level")).select("doc", snippets.outcome_fault("id", "level").alias("fault"))


@query("WITH d AS (SELECT page_id, '<p>' || url || '</p>' || html AS h FROM pages) SELECT page_id, COALESCE(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(h, '</?([A-Za-z][A-Za-z0-9]*)\\b[^>]*>', 1), lambda x: lower(x)), lambda x: x NOT IN ('p', 'b', 'br', 'i', 'code')))), ','), '') AS tags FROM d WHERE h IS NOT NULL")
def unexpected_tags(spark, sf):
    d = ad.table(spark, sf, "pages").where("url is not null and html is not null").select("page_id", F.concat(F.lit("<p>"), "url", F.lit("</p>"), "html").alias("h"))
    return d.select("page_id", F.array_join(F.array_sort(snippets.unexpected_tags("h", ("p", "b", "br", "i", "code"))), ",").alias("tags"))


@query("SELECT p_partkey AS doc, CASE WHEN p_size % 4 = 0 THEN 'no_front_matter' WHEN p_size % 4 = 1 THEN 'not_closed' END AS error, CASE WHEN p_size % 4 > 1 THEN p_name END AS title, CASE WHEN p_size % 4 > 1 THEN 'Intro,' || p_brand END AS sections FROM part WHERE p_name <> '' ")
def manifest_parts(spark, sf):
    p = ad.table(spark, sf, "part").where("p_name <> ''")
    head = F.concat(F.lit("---\ntitle: \""), "p_name", F.lit("\"\nstatus: meap\n"))
    body = F.concat(F.lit("## Intro\ntext\n### deeper\n## "), "p_brand", F.lit("  \n## Intro\n"))
    text = F.when(F.col("p_size") % 4 == 0, body).when(F.col("p_size") % 4 == 1, head).otherwise(F.concat(head, F.lit("---\n"), body))
    block, rest, error = snippets.front_matter("text")
    d = p.select(F.col("p_partkey").alias("doc"), text.alias("text"))
    sections = F.when(rest.isNotNull(), F.array_join(snippets.section_headers(rest), ","))
    return d.select("doc", error.alias("error"), snippets.field_of(block, "title").alias("title"), sections.alias("sections"))


@query(None)
def repeated_label_lines(spark, sf):
    d = ad.lines(spark, sf).withColumn("line", F.when(F.col("line_no") % 2 == 0, F.concat(F.lit("**Answer:** "), "line")).otherwise(F.col("line")))
    return identity.repeated_lines(d, "collection", "ord")
