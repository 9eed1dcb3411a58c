"""Queries of entity operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as N
from ..operators.order import numbered
from ..sources import adapters as D
from .registry import EDGES, EV, NODES, case, query
from .registry_search import ENT, entries

#: A small graph over words of the texts: (id, name, aliases, status, type).
PEOPLE = [("e1", "Apache", ["the apache", "licensed"], "confirmed", "org"), ("e2", "License", ["licensed under", "version"], "confirmed", "work"), ("e3", "Re", ["and re"], "confirmed", "word"), ("e4", "Und", [], "candidate", "word"), ("e5", "the license", ["copyright"], "confirmed", "work")]
TIES = [("e1", "e2", "colleague", "confirmed"), ("e2", "e3", "wife", "confirmed"), ("e3", "e4", "friend", "confirmed"), ("e5", "e1", "belongs_to", "candidate"), ("e1", "e5", "knows", "confirmed")]
_NAMES = [(e, n) for e, name, more, _, _ in PEOPLE for n in (name, *more)]
_Q = lambda v: "'" + v.replace("'", "''") + "'"
P0 = "p0(id, name, status) AS (VALUES " + ", ".join(f"({_Q(e)}, {_Q(n)}, {_Q(s)})" for e, n, _, s, _ in PEOPLE) + ")"
T0 = "t0(source, target, relation, status) AS (VALUES " + ", ".join("(" + ", ".join(map(_Q, t)) + ")" for t in TIES) + ")"


def _people(spark):
    return spark.createDataFrame(PEOPLE, "id string, name string, aliases array<string>, status string, type string")


def _ties(spark):
    return spark.createDataFrame(TIES, "source string, target string, relation string, status string")


def _within(text: str, term: str) -> str:
    """Text has every character that ends a word doubled, so that matches side by side don't share one."""
    t = "".join(c if c.isalnum() or c == "_" else 2 * c for c in term.lower())
    return f"regexp_matches({text}, '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)')"


_TWICE = "regexp_replace(lower(body), '([^a-z0-9_])', '\\1\\1', 'g')"


def _embedded_sql() -> str:
    ordered = sorted({(len(n), n.lower(), e) for e, n in _NAMES}, key=lambda x: (-x[0], x[1], x[2]))
    steps, last = [f"m0 AS (SELECT doc_id, {_TWICE} AS t FROM {ENT})"], "m0"
    for k, (_, n, _) in enumerate(ordered, 1):
        t = "".join(c if c.isalnum() or c == "_" else 2 * c for c in n)
        cols = "".join(f", c{i}" for i in range(1, k))
        steps.append(f"m{k} AS (SELECT doc_id, regexp_replace(t, '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)', '\\1' || chr(1) || '\\2', 'g') AS t{cols}, len(regexp_extract_all(t, '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)')) AS c{k} FROM {last})")
        last = f"m{k}"
    rows = " UNION ALL ".join(f"SELECT doc_id, '{e}' AS entity_id, c{k} AS n FROM {last}" for k, (_, _, e) in enumerate(ordered, 1))
    return f"WITH {', '.join(steps)} SELECT doc_id, entity_id, CAST(sum(n) AS BIGINT) AS n FROM ({rows}) WHERE n > 0 GROUP BY ALL"


@query(_embedded_sql())
def j5_g9_embedded_names(spark, d):
    t = D.table(spark, d, "documents")
    return N.embedded(t, _NAMES).select("doc_id", "entity_id", F.col("n").cast("long").alias("n"))


_HITS = " UNION ALL ".join(f"SELECT doc_id, date, '{e}' AS entity_id FROM y0 WHERE {' OR '.join(_within('b', n) for n in (name, *more))}" for e, name, more, _, _ in PEOPLE)
MENTIONS = f"y0 AS (SELECT doc_id, date, {_TWICE} AS b FROM {ENT}), h0 AS ({_HITS}), s1 AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC, doc_id DESC) AS place FROM h0 QUALIFY place <= 20)"


@query(f"WITH {MENTIONS} SELECT entity_id, doc_id, CAST(date AS VARCHAR) AS day, place FROM s1")
def j22_mentions(spark, d):
    return N.mentions(entries(spark, d), _NAMES).select("entity_id", "doc_id", F.col("date").cast("string").alias("day"), "place")


@query(f"""WITH {MENTIONS}, {P0}, {T0}, a AS (SELECT entity_id AS id, min(date) AS f, max(date) AS l, count(*) AS m FROM s1 GROUP BY 1),
r AS (SELECT source AS id, count(*) AS r FROM t0 WHERE status = 'confirmed' AND target IN (SELECT id FROM p0 WHERE status = 'confirmed') GROUP BY 1)
SELECT id, name, CAST(f AS VARCHAR) AS first_mention, CAST(l AS VARCHAR) AS latest_mention, coalesce(m, 0) AS mention_count, coalesce(r, 0) AS relationship_count, row_number() OVER (ORDER BY lower(name), id) AS place FROM p0 LEFT JOIN a USING (id) LEFT JOIN r USING (id) WHERE status = 'confirmed'""")
def a25_g6_g13_profiles(spark, d):
    p = N.profiles(_people(spark), _ties(spark), N.mentions(entries(spark, d), _NAMES))
    return p.withColumns({c: F.col(c).cast("string") for c in ("first_mention", "latest_mention")})


@case("SELECT unnest(['confirmed', 'candidate']) AS status, unnest([4, 1])::BIGINT AS n, unnest(['written', 'skipped']) AS outcome")
def g13_profile_counts(spark, d):
    return _people(spark).groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.when(F.col("status") == "confirmed", "written").otherwise("skipped"))


_LABELS = [("src1", "Alpha", "a"), (" SRC2 ", "Alpha", "a"), ("src3", "Beta", "b"), ("Src3", "Gamma", "c"), ("src4", "Delta", "d"), ("SRC4", "Delta", "d"), ("", "Nothing", "n")]


@query("""WITH m(k, c) AS (VALUES ('src1', 'Alpha'), ('src2', 'Alpha'), ('src4', 'Delta')) SELECT coalesce(c, source) AS value, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS variants, row_number() OVER (ORDER BY count(*) DESC, coalesce(c, source)) AS place FROM documents LEFT JOIN m ON lower(trim(source)) = k GROUP BY 1""")
def f3_a7_canonical_facet(spark, d):
    labels = spark.createDataFrame(_LABELS, "label string, canonical string, entity_id string")
    rows = N.canonical(D.table(spark, d, "documents").select("doc_id", "source"), "source", labels)
    n = rows.groupBy(F.col("canonical").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("variants"))
    from pyspark.sql import Window

    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))


_RELATION_SQL = "CASE WHEN label IN (" + ", ".join(map(_Q, N.RELATIONS)) + ") THEN label ELSE coalesce(map_extract(MAP {" + ", ".join(f"{_Q(n.lower())}: {_Q(c)}" for c, ns in N.RELATIONS.items() for n in ns) + "}, lower(label))[1], label) END"
_SAID = [n for ns in N.RELATIONS.values() for n in ns] + ["Wife", "spouse_of", "BUDDY", "unheard of"]


@case("SELECT label, " + _RELATION_SQL + " AS relation FROM (SELECT unnest([" + ", ".join(map(_Q, _SAID)) + "]) AS label)")
def f5_relation_synonyms(spark, d):
    return spark.createDataFrame([(x,) for x in _SAID], "label string").select("label", N.canonical_relation(F.col("label")).alias("relation"))


@query("SELECT doc_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS name FROM " + ENT)
def f2_name_keys(spark, d):
    return entries(spark, d).select("doc_id", F.trim(F.regexp_replace(F.lower("title"), r"\s+", " ")).alias("name"))


@query(f"WITH {EDGES}, {NODES} SELECT DISTINCT start, relation, id FROM (SELECT source AS start, relation, target AS id FROM e0 UNION ALL SELECT target, relation, source FROM e0) WHERE start IN (SELECT id FROM n0 WHERE type = 'place') AND relation = 'lives_in' AND id IN (SELECT id FROM n0 WHERE type = 'actor')")
def j6_edge_traversal(spark, d):
    n = D.entities(spark, d)
    return N.step(n.filter("type = 'place'"), D.edges(spark, d), "lives_in", "both", n.filter("type = 'actor'"))


_ROLES = [("n1", "observer", "me", "grandma"), ("n1", "observer", "me", "nan"), ("n2", "observer", "me", "uncle"), ("n2", "perspective", "child", "grandma"), ("n3", "perspective", "child", "grandma"), ("n4", "perspective", "child", "aunt"), ("n5", "perspective", "parent", "aunt"), ("n7", "observer", "you", "grandma")]


@case("SELECT unnest(['n1', 'n3', 'n5', 'n6', 'n7']) AS id")
def g10_role_labels(spark, d):
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(1, 8)], "id string")
    labels = spark.createDataFrame(_ROLES, "id string, scope string, by string, label string")
    return N.role_passes(nodes, labels, [("child", "grandma"), ("child", "nan")], "me")


PARTS = "q0 AS (SELECT p_partkey AS id, p_name AS name, [p_brand || '/' || p_type || '/' || p_size] AS aliases, CASE WHEN p_partkey % 9 = 0 THEN 'candidate' ELSE 'confirmed' END AS status FROM part)"
_KIN = {"a": ["b"]}


@query(f"""WITH {PARTS}, c AS (SELECT * FROM q0 WHERE status = 'confirmed'),
x AS (SELECT a.id AS id1, b.id AS id2, CASE WHEN list_has_any(list_append(a.aliases, a.name), list_append(b.aliases, b.name)) THEN 1 WHEN length(a.name) > 2 AND length(b.name) > 2 AND levenshtein(a.name, b.name) <= 1 THEN 3 END AS rank FROM c a JOIN c b ON a.id < b.id WHERE rank IS NOT NULL AND NOT (a.id % 10 = 0 AND b.id = a.id + 1))
SELECT id1, id2, CASE rank WHEN 3 THEN 'medium' ELSE 'high' END AS severity, CASE rank WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence, CASE rank WHEN 1 THEN 'alias_overlap' ELSE 'edit_distance' END AS signal FROM x""")
def j10_g3_duplicate_audit(spark, d):
    p = D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string"))).alias("aliases"), F.when(F.col("p_partkey") % 9 == 0, "candidate").otherwise("confirmed").alias("status"))
    reviewed = p.filter("id % 10 = 0").select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    return N.duplicates(p, reviewed)


@case("SELECT 'k1' AS id1, 'k2' AS id2, 'high' AS severity, 0.9::DOUBLE AS confidence, 'kinship' AS signal UNION ALL SELECT 'k3', 'k4', 'high', 1.0, 'alias_overlap'")
def j10_kinship_and_reviewed(spark, d):
    rows = [("k1", "妈妈", []), ("k2", "mom", []), ("k3", "Ann", ["A."]), ("k4", "Anne", ["A."]), ("k5", "Bob", []), ("k6", "Rob", [])]
    nodes = spark.createDataFrame([(*r, "confirmed") for r in rows], "id string, name string, aliases array<string>, status string")
    return N.duplicates(nodes, N.keep_separate(spark.createDataFrame([], "a string, b string"), "k6", "k5"))


@case("SELECT unnest(['x', 'p', 'q']) AS a, unnest(['y', 'q', 'p']) AS b")
def g12_keep_separate(spark, d):
    r = N.keep_separate(spark.createDataFrame([("x", "y"), ("u", "v"), ("v", "u")], "a string, b string"), "p", "q")
    return N.keep_separate(r, "v", "u", undo=True)


CARDS = "b0 AS (SELECT item_id AS doc_id, 'item-' || item_id AS title, '[[topic-' || (item_id % 7) || '|see]] ' || text AS body, [ 'p' || (item_id % 5), 'q' || (item_id % 3)] AS people, ['item-' || (item_id % 4)] AS related FROM benchmark)"


@query(f"""WITH {CARDS}, w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]+'))) AS v FROM b0), u AS (SELECT doc_id, unnest(v) AS x FROM w),
r AS (SELECT 'people_cooccurrence' AS type, people[1] AS source, people[2] AS target, doc_id FROM b0 UNION ALL SELECT 'related_entry', title, related[1], doc_id FROM b0
UNION ALL SELECT 'wikilink', title, trim(regexp_extract(body, '\\[\\[([^\\]|]+)', 1)), doc_id FROM b0 UNION ALL SELECT 'body_cooccurrence', a.x, b.x, a.doc_id FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.x < b.x)
SELECT type, source, target, count(DISTINCT doc_id) AS n, round(least(1.0::DOUBLE, count(DISTINCT doc_id) / 5), 4) AS confidence, CASE WHEN count(DISTINCT doc_id) >= 3 THEN 'confirm' WHEN count(DISTINCT doc_id) = 2 THEN 'review' ELSE 'low' END AS action FROM r GROUP BY 1, 2, 3""")
def g7_f9_candidate_edges(spark, d):
    n = F.col("item_id").cast("string")
    part = lambda p, k: F.concat(F.lit(p), (F.col("item_id") % k).cast("string"))
    e = D.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("item-"), n).alias("title"), F.concat(F.lit("[[topic-"), (F.col("item_id") % 7).cast("string"), F.lit("|see]] "), "text").alias("body"), F.array(part("p", 5), part("q", 3)).alias("people"), F.array(part("item-", 4)).alias("related"))
    return N.candidate_edges(e)


@query(f"WITH {EDGES} SELECT DISTINCT CASE source WHEN 'nation-1' THEN 'nation-2' WHEN 'nation-3' THEN 'nation-2' ELSE source END AS source, relation, CASE target WHEN 'nation-1' THEN 'nation-2' WHEN 'nation-3' THEN 'nation-2' ELSE target END AS target FROM e0")
def g8_merge_edges(spark, d):
    n = D.entities(spark, d).withColumn("aliases", F.array().cast("array<string>"))
    return N.merged(n, D.edges(spark, d), {"nation-1": "nation-2", "nation-3": "nation-2"})[1]


@query(f"WITH {NODES} SELECT id, name, CASE WHEN id = 'nation-2' THEN (SELECT string_agg(name, ',' ORDER BY name) FROM n0 WHERE id IN ('nation-1', 'nation-3')) ELSE '' END AS aliases FROM n0 WHERE id NOT IN ('nation-1', 'nation-3')")
def g8_merge_names(spark, d):
    n = D.entities(spark, d).withColumn("aliases", F.array().cast("array<string>"))
    return N.merged(n, D.edges(spark, d), {"nation-1": "nation-2", "nation-3": "nation-2"})[0].select("id", "name", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {EDGES} SELECT source, relation, target FROM e0 WHERE source <> 'nation-5' AND target <> 'nation-5'")
def g8_delete_entity(spark, d):
    return N.without(D.entities(spark, d), D.edges(spark, d), ["nation-5"])[1]


@query(f"WITH {EDGES} SELECT * FROM e0 UNION SELECT 'nation-1', 'friend_of', 'nation-2'")
def g8_add_relationship(spark, d):
    new = spark.createDataFrame([("nation-1", "Buddy", "nation-2"), ("nation-1", "朋友", "nation-2"), ("nation-1", "friend", "nobody")], "source string, relation string, target string")
    return N.add_relationship(D.edges(spark, d), D.entities(spark, d), new)


@query("SELECT unnest(['entity', 'entity', 'entity', 'entity', 'relationship', 'relationship', 'relationship', 'relationship', 'relationship']) AS kind, unnest(['nation-1', 'x1', 'x2', 'x3', '1', '2', '3', '4', '5']) AS id, unnest(['duplicate', 'new', 'conflict', 'conflict', 'new', 'duplicate', 'blocked', 'duplicate', 'unknown']) AS outcome")
def a34_batch_plan(spark, d):
    nodes, edges = D.entities(spark, d), D.edges(spark, d)
    own = nodes.filter("id = 'nation-2'").select(F.lit("x3").alias("id"), F.upper("name").alias("name"))
    new = spark.createDataFrame([("nation-1", "Any"), ("x1", "New Name"), ("x2", "new name")], "id string, name string").unionByName(own)
    first = edges.filter("source = 'nation-1'").select(F.lit(4).cast("long").alias("no"), "source", "relation", "target")
    links = spark.createDataFrame([(1, "x1", "knows", "nation-1"), (2, "x1", "knows", "nation-1"), (3, "x2", "knows", "x1"), (5, "x1", "knows", "nobody")], "no long, source string, relation string, target string").unionByName(first)
    return N.batch_plan(nodes, edges, new, links)


@query(f"WITH d AS (SELECT DISTINCT user_id, date, topic FROM {EV}), p AS (SELECT a.topic AS a, b.topic AS b, count(*) AS n FROM d a JOIN d b ON a.user_id = b.user_id AND a.date = b.date AND a.topic < b.topic GROUP BY 1, 2 HAVING n >= 3) SELECT * FROM p WHERE NOT (a = 'click' AND b = 'view')")
def a17_seen_together_without_relation(spark, d):
    from ..operators import graph as G

    pairs = G.cooccurrence(D.event_entries(spark, d), ["user_id", "date"], "topic").select("a", "b", F.col("n_groups").alias("n"))
    names = spark.createDataFrame([("click", "t1"), ("view", "t2"), ("error", "t3")], "name string, id string")
    return N.without_relation(pairs, names, spark.createDataFrame([("t2", "t1")], "source string, target string"))


@query("""WITH r AS (SELECT lang AS name, 'people' AS field, doc_id FROM documents UNION ALL SELECT source, 'place', doc_id FROM documents UNION ALL SELECT lang, 'tag', doc_id FROM documents WHERE n_chars > 2000), c AS (SELECT name, field, count(*) AS n FROM r GROUP BY 1, 2)
SELECT name, CAST(sum(n) AS BIGINT) AS frequency, arg_min(field, (-n, field)) AS field FROM c GROUP BY name HAVING sum(n) >= 2""")
def a15_seed_names(spark, d):
    t = D.table(spark, d, "documents")
    rows = t.select(F.col("lang").alias("name"), F.lit("people").alias("field")).unionByName(t.select(F.col("source").alias("name"), F.lit("place").alias("field"))).unionByName(t.filter("n_chars > 2000").select(F.col("lang").alias("name"), F.lit("tag").alias("field")))
    return N.seeds(rows)


@query(f"""WITH {EDGES}, {NODES}, x AS (SELECT 'total' AS kind, '' AS key, count(*) AS n FROM n0 UNION ALL SELECT 'type', type, count(*) FROM n0 GROUP BY type UNION ALL SELECT 'relationships', '', count(*) FROM e0 UNION ALL SELECT 'aliases', '', count(*) FROM n0 WHERE type = 'place'
UNION ALL (SELECT 'incoming', target, count(*) AS n FROM e0 GROUP BY target ORDER BY n DESC, target LIMIT 10) UNION ALL (SELECT 'pairs', least(source, target) || '|' || greatest(source, target), count(*) AS n FROM e0 GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)) SELECT * FROM x""")
def a13_g5_entity_totals(spark, d):
    n, e = D.entities(spark, d).withColumn("aliases", F.when(F.col("type") == "place", F.array(F.lower("name"))).otherwise(F.array().cast("array<string>"))), D.edges(spark, d)
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), key.alias("key"), value.cast("long").alias("n"))
    top = lambda key: e.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(10)
    out = row(n.agg(F.count(F.lit(1)).alias("n")), "total", F.lit(""), F.col("n"))
    out = out.unionByName(row(n.groupBy("type").count(), "type", F.col("type"), F.col("count"))).unionByName(row(e.agg(F.count(F.lit(1)).alias("n")), "relationships", F.lit(""), F.col("n")))
    out = out.unionByName(row(n.agg(F.sum(F.size("aliases")).alias("n")), "aliases", F.lit(""), F.col("n")))
    pair = F.concat_ws("|", F.least("source", "target"), F.greatest("source", "target"))
    return out.unionByName(row(top(F.col("target")), "incoming", F.col("key"), F.col("n"))).unionByName(row(top(pair), "pairs", F.col("key"), F.col("n")))


@query(f"""WITH {EDGES}, {NODES}, i AS (SELECT row_number() OVER (ORDER BY k, id) AS no, * FROM (SELECT 1 AS k, 'possible_duplicate' AS type, 'high' AS severity, id FROM n0 WHERE id = 'nation-7' UNION ALL SELECT 2, 'incomplete_relationship', 'low', id FROM n0 WHERE id NOT IN (SELECT source FROM e0) UNION ALL SELECT 3, 'candidate_entity', 'unclear', id FROM n0 WHERE id NOT IN (SELECT target FROM e0) AND type = 'place'))
SELECT 'review-' || no AS item_id, CASE WHEN severity IN ('high', 'medium', 'low') THEN severity ELSE 'medium' END AS risk, type AS category, id AS ids, CASE type WHEN 'possible_duplicate' THEN 'merge_as_alias,keep_separate,skip' WHEN 'incomplete_relationship' THEN 'add_relationship,skip' ELSE 'confirm_candidate,reject_candidate,skip' END AS actions,
row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, no) AS place FROM i""")
def g11_review_queue(spark, d):
    n, e = D.entities(spark, d), D.edges(spark, d)
    row = lambda df, k, kind, severity: df.select(F.lit(k).alias("k"), F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col("id").alias("ids"))
    found = row(n.filter("id = 'nation-7'"), 1, "possible_duplicate", "high").unionByName(row(n.join(e.select(F.col("source").alias("id")), "id", "left_anti"), 2, "incomplete_relationship", "low")).unionByName(row(n.filter("type = 'place'").join(e.select(F.col("target").alias("id")), "id", "left_anti"), 3, "candidate_entity", "unclear"))
    return N.review_queue(numbered(found, "no", "k", "ids").drop("k"))


_FRAGMENTS = [("q1", "The"), ("q2", "re"), ("q3", " "), ("q4", "Licensed under")]


@query(f"WITH f(query_id, fragment) AS (VALUES {', '.join(f'({_Q(a)}, {_Q(b)})' for a, b in _FRAGMENTS)}), t AS (SELECT doc_id, title FROM {ENT}), x AS (SELECT query_id, doc_id FROM f JOIN t ON title = fragment WHERE trim(fragment) <> '') SELECT DISTINCT * FROM (SELECT * FROM x UNION ALL SELECT query_id, doc_id FROM f JOIN t ON contains(title, fragment) WHERE trim(fragment) <> '' AND query_id NOT IN (SELECT query_id FROM x))")
def j19_titles_to_documents(spark, d):
    return N.titles_to_ids(spark.createDataFrame(_FRAGMENTS, "query_id string, fragment string"), entries(spark, d).select("doc_id", "title"))
