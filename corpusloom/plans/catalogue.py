"""The registered queries of the document operators, each over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import normalize as N
from corpusloom.operators import chunks, findings, hygiene, reconcile, similarity, structure, tables
from corpusloom.plans import office, restyled, texts  # noqa: F401  register their queries
from corpusloom.plans.registered import dealt, oracle_sql, queries, query, read  # noqa: F401

def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.normal_lines(read(spark, sf_dir, "documents"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with spaces put where they don't belong, the same in both engines."""
    return read(spark, sf_dir, "documents").select("doc_id", F.replace(F.replace("text", F.lit(", "), F.lit(" ,")), F.lit(". "), F.lit(".  ")).alias("text"))


LINES = "lines AS (SELECT doc_id AS doc, (i - 1)::INT AS idx, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"
DIRTY = "dirty AS (SELECT doc_id, replace(replace(text, ', ', ' ,'), '. ', '.  ') AS text FROM documents)"
NORM = r"trim(regexp_replace(coalesce({}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"

# --- reconciling ---

ORDER_FIELDS = ["o_custkey", "o_orderpriority", "o_orderstatus"]


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and a changed copy: keys that 7 divides dropped, by 11 another status, by 13 another key."""
    a = read(spark, sf_dir, "orders").select("o_orderkey", *ORDER_FIELDS)
    b = a.filter("o_orderkey % 7 <> 0").withColumns({
        "o_orderstatus": F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_orderkey": F.when(F.col("o_orderkey") % 13 == 0, F.col("o_orderkey") + 1_000_000_000).otherwise(F.col("o_orderkey")),
    })
    return a, b


_RECONCILED = """
WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, min(o_custkey) AS c, min(lower(trim(o_orderpriority))) AS pl, min(trim(o_orderpriority)) AS p, min(trim(o_orderstatus)) AS s, count(*) AS n FROM orders WHERE o_orderkey <> 0 GROUP BY 1),
b AS (SELECT CAST(CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS VARCHAR) AS key, min(o_custkey) AS c, min(trim(o_orderpriority)) AS p,
      min(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE trim(o_orderstatus) END) AS s, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.key, b.key) AS key, a.key AS ka, b.key AS kb, a.s AS sa, b.s AS sb, a.n AS n_a, b.n AS n_b,
      CASE WHEN b.key IS NULL THEN 'only_a' WHEN a.key IS NULL THEN 'only_b' WHEN a.s <> b.s OR a.p <> b.p OR a.c <> b.c THEN 'mismatched' ELSE 'exact' END AS status
      FROM a FULL OUTER JOIN b ON a.key = b.key)
"""


@query(_RECONCILED + "SELECT key, status, n_a, n_b FROM j")
def reconcile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*_orders(spark, sf_dir), ["o_orderkey"], ORDER_FIELDS).select("key", "status", "n_a", "n_b")


@query(_RECONCILED + "SELECT status, count(*) AS n, sum(coalesce(n_a, 0) + coalesce(n_b, 0))::BIGINT AS source_rows FROM j GROUP BY status")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("source_rows"))


@query(_RECONCILED + "SELECT key, 'o_orderstatus' AS field, sa AS a, sb AS b FROM j WHERE status = 'mismatched' AND sa <> sb")
def reconcile_field_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile(*_orders(spark, sf_dir), ["o_orderkey"], ORDER_FIELDS).select("key", F.explode("diffs").alias("d")).select("key", "d.*")


@query("SELECT 'n_regionkey' AS key_column UNION ALL SELECT 'regionkey'")
def auto_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    first = reconcile.auto_key(["n_regionkey", "n_name"], nation.columns)
    second = reconcile.auto_key([c[2:] for c in region.columns if c.endswith("key")], [c[2:] for c in nation.columns])
    return spark.createDataFrame([(k,) for k in [*first, *second]], "key_column string")


@query("SELECT count(*) AS left_keys, count(*) FILTER (o_orderkey % 7 <> 0) AS shared, count(*) FILTER (o_orderkey % 7 = 0) AS left_only FROM (SELECT DISTINCT o_orderkey FROM orders)")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select("o_orderkey")
    b = a.filter("o_orderkey % 7 <> 0")
    marked = a.distinct().join(b.distinct().withColumn("b", F.lit(True)), "o_orderkey", "left")
    return marked.agg(F.count("*").alias("left_keys"), F.count("b").alias("shared"), F.count_if(F.col("b").isNull()).alias("left_only"))


CELL_COLUMNS = ["s_name", "s_nationkey", "phone"]
_SUPPLIERS = "SELECT s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '' END AS phone FROM supplier"


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").withColumn("phone", F.when(F.col("s_suppkey") % 3 == 0, None).otherwise(""))


@query(f"""WITH s AS ({_SUPPLIERS}), a AS (SELECT s_suppkey AS row, 1 AS col, s_name AS v FROM s UNION ALL SELECT s_suppkey, 2, nation FROM s UNION ALL SELECT s_suppkey, 3, phone FROM s),
b AS (SELECT row, col, CASE WHEN col = 2 AND row % 5 = 0 THEN v || '0' WHEN col = 3 THEN '' ELSE v END AS v FROM a WHERE row % 17 <> 0)
SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col)::INT AS col, a.v AS value_a, b.v AS value_b, ['A', 'B', 'C'][coalesce(a.col, b.col)] || coalesce(a.row, b.row) AS address
FROM a FULL OUTER JOIN b ON a.row = b.row AND a.col = b.col WHERE a.v IS DISTINCT FROM b.v""")
def cells_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reconcile.melt(_suppliers(spark, sf_dir), "a", "s_suppkey", CELL_COLUMNS)
    changed = F.when((F.col("col") == 2) & (F.col("row") % 5 == 0), F.concat("value", F.lit("0"))).when(F.col("col") == 3, "").otherwise(F.col("value"))
    b = a.filter("row % 17 <> 0").withColumn("value", changed)
    return reconcile.diff_cells(a, b).withColumn("address", N.a1(F.col("row"), F.col("col")))


@query("""WITH s AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 4 = 0 THEN ' ' ELSE s_name END AS a, CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN '' ELSE '0' END AS b FROM supplier)
SELECT 's' AS book, row, row_number() OVER (ORDER BY row) AS new_row, 2::BIGINT AS cells FROM s WHERE coalesce(trim(a) <> '', false) OR coalesce(trim(b) <> '', false)""")
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(k % 4 == 0, " ").otherwise(F.col("s_name")).alias("a"), F.when(k % 6 == 0, None).when(k % 4 == 0, "").otherwise("0").alias("b"))
    return reconcile.drop_empty_rows(reconcile.melt(s, "s", "s_suppkey", ["a", "b"]), ["book"])


# --- duplicates and similarity ---


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.exact_groups(read(spark, sf_dir, "documents").filter("text is not null"), "doc_id", "text")


_SETS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[0-9A-Za-zА-Яа-яЁё_]+') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w WHERE len(w) >= 5),
classes AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets GROUP BY s),
items AS (SELECT id, n, unnest(s) AS x FROM classes),
shared AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM items a JOIN items b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
"""


@query(_SETS + "SELECT a, b, shared, shared / (na + nb - shared) AS similarity FROM shared WHERE shared / (na + nb - shared) >= 0.5")
def shingle_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similar_pairs(dealt(read(spark, sf_dir, "documents"), "doc_id"), 0.5)


@query()
def sketch_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", similarity.words(F.col("text")).alias("w"))
    return docs.select("doc_id", similarity.sketch(F.col("w"), 5, 64).alias("s")).select("doc_id", F.size("s").alias("n"), F.array_max("s").alias("largest"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query()
def near_dupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs, then their sections matched, weighed and judged; only documents of a pair are cut into sections."""
    from corpusloom.plans.session import checkpoints

    docs = dealt(read(spark, sf_dir, "documents"), "doc_id")
    checkpoints(spark)
    pairs = similarity.similar_pairs(docs, 0.5).checkpoint()  # read five times
    paired = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    secs = similarity.line_sections(similarity.normal_lines(docs.join(paired, "doc_id", "left_semi"))).checkpoint()
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  its own column ids
    side = lambda own: fresh(fresh(pairs.select("a", "b")).join(fresh(secs.withColumnRenamed("doc", own)), own).select("a", "b", "ordinal", "title", "shingles", F.size("shingles").alias("words")))
    a, b = side("a"), side("b")
    found = similarity.section_alignment(a, b, ["a", "b"])
    words_of = lambda s, n: s.select(F.col("a").alias(f"{n}_a"), F.col("b").alias(f"{n}_b"), F.col("ordinal").alias(f"{n}_at"), F.col("words").alias(f"words_{n}"))
    on = lambda n: (F.col("a") == F.col(f"{n}_a")) & (F.col("b") == F.col(f"{n}_b")) & (F.col(f"{n}_ordinal") == F.col(f"{n}_at"))
    weighed = found.join(words_of(a, "a"), on("a"), "left").join(words_of(b, "b"), on("b"), "left")
    s = similarity.structural_similarity(weighed, ["a", "b"])
    n = weighed.groupBy("a", "b").agg(F.count_if(F.col("similarity") >= 0.8).alias("reliable"), F.count_if((F.col("similarity") > 0) & (F.col("similarity") < 0.8)).alias("check"), F.count_if(F.col("similarity") == 0).alias("doubtful"), F.count("*").alias("rows"))
    out = pairs.join(s, ["a", "b"]).join(n, ["a", "b"])
    return out.select("a", "b", "similarity", "structural", "reliable", "check", "doubtful", similarity.recommendation(F.col("similarity"), F.col("structural"), F.col("reliable"), F.col("check"), F.col("doubtful"), F.col("rows")).alias("recommendation"))


@query("""WITH t AS (SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) AS z, c_nationkey AS n FROM customer)
SELECT c_custkey, CASE WHEN z || n = 'A7' THEN [z || n] ELSE [z || n, 'A7'] END AS codes FROM t""")
def zone_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    text = F.concat(F.lit("zone ("), F.lower(F.substring("c_mktsegment", 1, 1)), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(") and (A 7)"))
    return c.select("c_custkey", similarity.zone_codes(text).alias("codes"))


@query("""WITH m AS (SELECT l_orderkey AS o, l_discount * 10 AS sim, greatest(CAST(l_quantity AS INT), 1) AS w FROM lineitem)
SELECT o AS l_orderkey, round(sum(sim * w) / sum(w), 6) AS structural FROM m GROUP BY o""")
def weighted_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("similarity"), F.col("l_quantity").cast("int").alias("words_a"), F.lit(None).cast("int").alias("words_b"))
    return similarity.structural_similarity(m, ["l_orderkey"]).withColumn("structural", F.round("structural", 6))


# --- text ---


@query(f"WITH {DIRTY} SELECT doc_id, len(regexp_extract_all(text, ' {{2,}}'))::BIGINT AS double_space, len(regexp_extract_all(text, '(?:^|[^,;: ]) +[,.;:!?]'))::BIGINT AS space_before_punct, len(regexp_extract_all(text, chr(173)))::BIGINT AS soft_hyphen FROM dirty")
def hygiene_scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = hygiene.counts(F.col("text"))
    return dirty(spark, sf_dir).select("doc_id", *[c[k].alias(k) for k in ("double_space", "space_before_punct", "soft_hyphen")])


@query(f"WITH {DIRTY}, one AS (SELECT doc_id, regexp_replace(text, ' {{2,}}', ' ', 'g') AS t FROM dirty) SELECT doc_id, sha256(regexp_replace(t, '(^|[^,;: ]) +([,.;:!?])', '\\1\\2', 'g')) AS fixed FROM one")
def hygiene_fix_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace("text", hygiene.DOUBLE_SPACE, " "), hygiene.SPACE_BEFORE_PUNCT, "$1")
    return dirty(spark, sf_dir).select("doc_id", F.sha2(t.cast("binary"), 256).alias("fixed"))


@query()
def hygiene_fix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("doc_id", hygiene.fix(F.col("text"), True).alias("fixed"))


@query("SELECT doc_id, len(t) - len(replace(t, chr(173), '')) AS dropped, sha256(replace(t, chr(173), '')) AS cleaned FROM (SELECT doc_id, replace(text, 'on', 'o' || chr(173) || 'n') AS t FROM documents)")
def nonprinting_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("on"), F.lit("o­n")).alias("t"))
    clean = hygiene.drop_nonprinting(F.col("t"))
    return d.select("doc_id", (F.length("t") - F.length(clean)).cast("long").alias("dropped"), F.sha2(clean.cast("binary"), 256).alias("cleaned"))


@query(f"WITH {LINES} SELECT count(*) AS n, count(DISTINCT translate(lower(" + NORM.format("text") + "), 'ё', 'е')) AS keys FROM lines")
def norm_key_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct(N.norm_key(F.col("text"))).alias("keys"))


@query("SELECT doc_id, len(text)::INT AS n, substr(text, 1, 100) AS head, substr(sha1(substr(text, 1, 100)), 1, 12) AS context_hash FROM documents")
def context_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.substring("text", 1, 100)
    return read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), head.alias("head"), N.stable_hash(head).alias("context_hash"))


@query(f"WITH {LINES} SELECT doc, idx, text FROM lines WHERE len(regexp_extract_all(text, '\\p{{L}}')) >= 8 AND len(regexp_extract_all(text, '\\p{{Lu}}')) >= 0.85 * len(regexp_extract_all(text, '\\p{{L}}'))")
def caps_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).filter(N.is_caps(F.col("text")))


@query("SELECT p_partkey, array_to_string(string_split(trim(regexp_replace(p_name, '[^0-9A-Za-z_ -]', '', 'g')), ' ')[1:6], '_') AS slug FROM part")
def title_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", N.slug(F.col("p_name"), 6).alias("slug"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) WHEN doc_id % 3 = 1 THEN replace(text, chr(10), chr(13)) ELSE text END AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '\\r\\n'))::BIGINT AS crlf, (len(t) - len(replace(t, chr(10), '')) - len(regexp_extract_all(t, '\\r\\n')))::BIGINT AS lf, (len(t) - len(replace(t, chr(13), '')) - len(regexp_extract_all(t, '\\r\\n')))::BIGINT AS cr FROM t""".replace("\\\\", "\\"))
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).when(k == 1, F.replace("text", F.lit("\n"), F.lit("\r"))).otherwise(F.col("text"))
    n = lambda p: F.regexp_count("t", F.lit(p)).cast("long")
    return d.select("doc_id", t.alias("t")).select("doc_id", n("\r\n").alias("crlf"), n("(?<!\r)\n").alias("lf"), n("\r(?!\n)").alias("cr"))


# --- ordered structure ---


@query(f"""WITH {LINES}, b AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM lines WHERE len(text) < 60)
SELECT doc, min(idx) AS first, max(idx) AS last, count(*) AS n FROM b GROUP BY doc, g HAVING count(*) >= 2""")
def short_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.runs(lines(spark, sf_dir), F.length("text") < 60, 2)


BLANKED = "blanked AS (SELECT doc, idx, CASE WHEN idx % 4 IN (1, 2) THEN '' ELSE text END AS text FROM lines)"


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).withColumn("text", F.when(F.col("idx") % 4 < 3, F.when(F.col("idx") % 4 > 0, "").otherwise(F.col("text"))).otherwise(F.col("text")))


@query(f"WITH {LINES}, {BLANKED}, b AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM blanked WHERE trim(text) = '') SELECT doc, min(idx) AS first, max(idx) AS last, count(*) AS n FROM b GROUP BY doc, g HAVING count(*) >= 2")
def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.runs(_blanked(spark, sf_dir), F.trim("text") == "", 2)


@query(f"WITH {LINES}, {BLANKED}, l AS (SELECT doc, idx, text, trim(text) = '' AS r, lag(trim(text) = '') OVER (PARTITION BY doc ORDER BY idx) AS p FROM blanked) SELECT doc, idx, text FROM l WHERE NOT (r AND coalesce(p, false))")
def blank_runs_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.collapse(_blanked(spark, sf_dir), F.trim("text") == "")


@query(f"""WITH {LINES}, m AS (SELECT doc, idx, text, idx % 3 = 0 AS h, idx % 3 = 2 AND trim(text) <> '' AS c FROM lines),
n AS (SELECT doc, idx, text, h, min(CASE WHEN h THEN idx END) OVER w AS nh, min(CASE WHEN c AND NOT h THEN idx END) OVER w AS nc FROM m WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT doc, idx, text FROM n WHERE h AND (nc IS NULL OR nh < nc)""")
def heading_no_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("idx") % 3
    return structure.heading_without_content(lines(spark, sf_dir), k == 0, (k == 2) & (F.trim("text") != ""))


@query(f"""WITH {LINES}, s AS (SELECT doc, idx, text, lag(text) OVER (PARTITION BY doc ORDER BY idx) AS p FROM lines),
f AS (SELECT *, NOT coalesce(p IS NOT NULL AND trim(p) <> '' AND NOT regexp_matches(trim(p), '[.!?:;…]$') AND regexp_matches(text, '^\\s*\\p{{Ll}}'), false) AS new FROM s),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc ORDER BY idx) AS g FROM f)
SELECT doc, min(idx) AS first, count(*) AS n, string_agg(trim(text), ' ' ORDER BY idx) AS text FROM g GROUP BY doc, g""")
def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.joined_paragraphs(lines(spark, sf_dir))


@query(f"""WITH {LINES}, k AS (SELECT doc, idx, substr(text, 1, 1) AS k, lag(substr(text, 1, 1)) OVER (PARTITION BY doc ORDER BY idx) AS p, row_number() OVER (PARTITION BY doc ORDER BY idx) AS r FROM lines),
g AS (SELECT *, sum((r = 1 OR k IS DISTINCT FROM p)::INT) OVER (PARTITION BY doc ORDER BY idx) AS section FROM k)
SELECT doc, section::BIGINT AS section, min(k) AS key, min(idx) AS first, count(*) AS n FROM g GROUP BY doc, section""")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.sections(lines(spark, sf_dir), F.substring("text", 1, 1))



def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions numbered order.line, some missing."""
    rows = read(spark, sf_dir, "lineitem").filter("l_partkey % 9 <> 0")
    text = F.concat(F.lit("Таблица "), (F.col("l_orderkey") % 50).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(" - итоги"))
    return rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), text.alias("text"))


@query("""WITH c AS (SELECT l_orderkey AS doc, l_orderkey * 10 + l_linenumber AS idx, (l_orderkey % 50)::INT AS a, l_linenumber AS b FROM lineitem WHERE l_partkey % 9 <> 0),
p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb FROM c WINDOW w AS (PARTITION BY doc ORDER BY idx)),
i AS (SELECT doc, idx, a || '.' || b AS num, CASE WHEN pa IS NULL THEN NULL WHEN a < pa OR (a = pa AND b < pb) THEN 'reverse' WHEN a = pa AND b = pb THEN 'duplicate' WHEN a = pa AND b - pb > 1 THEN 'gap' END AS issue FROM p)
SELECT * FROM i WHERE issue IS NOT NULL""")
def caption_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _captions(spark, sf_dir).withColumn("c", structure.caption(F.col("text"))).filter("c is not null").select("doc", "idx", "c.num")
    return structure.number_sequence(c, ["doc"])


@query("SELECT l_orderkey % 50 || '.' || l_linenumber AS num, 'table' AS kind, min(l_orderkey * 10 + l_linenumber) AS first, count(*) AS n FROM lineitem WHERE l_partkey % 9 <> 0 GROUP BY 1 HAVING count(*) > 1")
def caption_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _captions(spark, sf_dir).withColumn("c", structure.caption(F.col("text"))).filter("c is not null").select("idx", "c.kind", "c.num")
    return structure.duplicates(c, ["kind", "num"])


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS idx, l_linenumber AS v FROM lineitem WHERE l_partkey % 9 <> 0), p AS (SELECT *, lag(v) OVER (PARTITION BY doc ORDER BY idx) AS pv, count(*) OVER (PARTITION BY doc) AS al FROM n),
i AS (SELECT doc, idx, CAST(v AS VARCHAR) AS num FROM p WHERE al >= 2 AND v - pv > 1) SELECT doc, min(idx) AS idx, 'gap' AS issue, arg_min(num, idx) AS num FROM i GROUP BY doc""")
def list_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "lineitem").filter("l_partkey % 9 <> 0").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), F.col("l_linenumber").cast("string").alias("num")).distinct()
    return structure.first_violation(n, ["doc"])


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
j AS (SELECT o.user_id, o.idx, m.idx AS mark_idx, abs(o.idx - m.idx) AS distance, row_number() OVER (PARTITION BY o.user_id, o.idx ORDER BY abs(o.idx - m.idx), m.idx) AS r
      FROM e o JOIN e m ON o.user_id = m.user_id AND o.event_type = 'purchase' AND m.event_type = 'view' AND abs(o.idx - m.idx) BETWEEN 1 AND 4)
SELECT user_id, idx::INT AS idx, mark_idx::INT AS mark_idx, distance::INT AS distance, CASE WHEN mark_idx < idx THEN 'before' ELSE 'after' END AS side FROM j WHERE r = 1""")
def nearest_caption(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"))
    return structure.nearest(e.filter("event_type = 'purchase'").select("user_id", "idx"), e.filter("event_type = 'view'"), ["user_id"])


_MAJORITY = """v AS (SELECT l_suppkey, l_returnflag, count(*) AS votes, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_suppkey, l_returnflag, votes, sum(votes) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, f) AS r FROM v)"""


@query(f"WITH {_MAJORITY} SELECT l_suppkey, l_returnflag, votes, total::BIGINT AS total FROM m WHERE r = 1")
def majority_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return structure.majority(rows, ["l_suppkey"], "l_returnflag", "at")


@query(f"WITH {_MAJORITY} SELECT l.l_suppkey, l.l_returnflag, count(*) AS outliers FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey AND r = 1 AND l.l_returnflag <> m.l_returnflag GROUP BY 1, 2")
def majority_profile_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    usual = majority_profile(spark, sf_dir).select("l_suppkey", F.col("l_returnflag").alias("usual"))
    return read(spark, sf_dir, "lineitem").join(usual, "l_suppkey").filter("l_returnflag <> usual").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("outliers"))


@query("""WITH v AS (SELECT l_suppkey, l_shipmode, sum(w) AS votes, min(f) AS f FROM (SELECT l_suppkey, l_linestatus AS l_shipmode, least(CAST(l_quantity AS INT), 24) AS w, l_orderkey * 10 + l_linenumber AS f FROM lineitem) GROUP BY 1, 2),
m AS (SELECT l_suppkey, l_shipmode, votes, sum(votes) OVER (PARTITION BY l_suppkey) AS total, row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, f) AS r FROM v) SELECT l_suppkey, l_shipmode AS l_linestatus, votes::BIGINT AS votes, total::BIGINT AS total FROM m WHERE r = 1""")
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return structure.majority(rows, ["l_suppkey"], "l_linestatus", "at", F.least(F.col("l_quantity").cast("int"), F.lit(24)))


@query(f"""WITH {LINES} SELECT doc, idx, (coalesce(sum((len(text) < 100)::INT) OVER w, 0) + 1)::BIGINT AS page, (coalesce(sum((len(text) < 60)::INT) OVER w, 0) + 1)::BIGINT AS part FROM lines
WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.counters(lines(spark, sf_dir), {"page": F.length("text") < 100, "part": F.length("text") < 60}).select("doc", "idx", "page", "part")


@query("""WITH s AS (SELECT DISTINCT user_id, value::INT AS k FROM events WHERE event_type = 'view'), e AS (SELECT DISTINCT user_id, value::INT AS k FROM events WHERE event_type = 'purchase')
SELECT coalesce(s.user_id, e.user_id) AS user_id, coalesce(s.k, e.k) AS k, CASE WHEN e.k IS NULL THEN 'start-without-end' ELSE 'end-without-start' END AS issue FROM s FULL OUTER JOIN e ON s.user_id = e.user_id AND s.k = e.k WHERE s.k IS NULL OR e.k IS NULL""")
def unpaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.rint("value").cast("int"))
    return structure.unpaired(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), ["user_id", "k"])


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 3 AS dst FROM part WHERE p_partkey > 0), r(id) AS (SELECT p_partkey FROM part WHERE p_partkey % 97 = 5 UNION SELECT dst FROM r JOIN e ON r.id = e.src) SELECT id FROM r""")
def style_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.plans.session import checkpoints

    checkpoints(spark)
    part = read(spark, sf_dir, "part")
    edges = part.filter("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).cast("long").alias("dst"))
    return structure.closure(part.filter("p_partkey % 97 = 5").select(F.col("p_partkey").alias("id")), edges)


# --- tables ---


@query("""WITH c AS (SELECT 1 AS col, c_name AS v FROM customer UNION ALL SELECT 2, c_mktsegment FROM customer UNION ALL SELECT 3, CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT col::INT AS col, round(quantile_cont(length(v), 0.6), 6) AS p60, round(quantile_cont(length(v), 0.85), 6) AS p85, max(length(v))::BIGINT AS longest FROM c GROUP BY col""")
def percentile_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reconcile.melt(read(spark, sf_dir, "customer"), "c", "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])
    return tables.column_scores(cells, ["col"]).select("col", F.round("p60", 6).alias("p60"), F.round("p85", 6).alias("p85"), "longest")


@query(r"""WITH c AS (SELECT 1 AS col, p_name AS v FROM part UNION ALL SELECT 2, p_brand FROM part UNION ALL SELECT 3, p_type FROM part UNION ALL SELECT 4, CAST(p_size AS VARCHAR) FROM part),
s AS (SELECT col, quantile_cont(length(v), 0.6) AS p60, quantile_cont(length(v), 0.85) AS p85, avg(length(v)) AS av, avg((regexp_matches(v, '^\s*[-+]?\d[\d\s]*(?:[.,]\d+)?\s*%?\s*$'))::INT) AS num, avg((length(v) >= 40)::INT) AS lng FROM c GROUP BY col),
k AS (SELECT col, greatest((p85 * 0.5 + av * 0.3 + p60 * 0.2) * (1 + lng) * CASE WHEN num > 0.6 THEN 0.7 ELSE 1 END, 1) AS score FROM s)
SELECT col::INT AS col, round(score, 6) AS score, round(1.0 + (17.0 - 4) * score / sum(score) OVER (), 6) AS width FROM k""")
def column_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = reconcile.melt(read(spark, sf_dir, "part"), "p", "p_partkey", ["p_name", "p_brand", "p_type", "p_size"])
    scored = tables.column_scores(cells, ["book", "col"])
    return tables.widths(scored, ["book"], 17.0, 1.0).select("col", F.round("score", 6).alias("score"), F.round("width", 6).alias("width"))


_MD = "md AS (SELECT conv_id AS doc, turn, '| ' || role || ' | ' || left(regexp_replace(text, '[|\\n\\r]', ' ', 'g'), 40) || ' |' AS l, role, trim(left(regexp_replace(text, '[|\\n\\r]', ' ', 'g'), 40)) AS t FROM conversations)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a pipe table of role and text."""
    c = read(spark, sf_dir, "conversations")
    text = F.substring(F.regexp_replace("text", "[|\n\r]", " "), 1, 40)
    body = c.select(F.col("conv_id").alias("doc"), (F.col("turn") + 10).alias("idx"), F.concat(F.lit("| "), "role", F.lit(" | "), text, F.lit(" |")).alias("text"))
    head = c.select(F.col("conv_id").alias("doc")).distinct().select("doc", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), F.lit(t).alias("text")) for i, t in ((7, "## Chat"), (8, "| role | text |"), (9, "|---|:---:|"))])).alias("h")).select("doc", "h.*")
    return head.unionByName(body)


@query(f"""WITH {_MD}, r AS (SELECT doc, role, t, row_number() OVER (PARTITION BY doc ORDER BY turn) AS n FROM md)
SELECT doc, 8::BIGINT AS "table", 0 AS row, ['role', 'text'] AS cells FROM (SELECT DISTINCT doc FROM md) UNION ALL SELECT doc, 8, n::INT, [role, t] FROM r""")
def md_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown_rows(_markdown(spark, sf_dir))


@query("""SELECT conv_id AS doc, 8::BIGINT AS start, max(turn) + 10 AS "end", count(*) + 2 AS n_rows, 'Chat' AS h2, NULL AS h3 FROM conversations GROUP BY conv_id""")
def md_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.markdown_outline(_markdown(spark, sf_dir))


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, sum(length(CAST(l_partkey AS VARCHAR)) + 600 * (l_linenumber % 2)) AS chars FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_filter([CASE WHEN n >= 7 THEN 'columns' END, CASE WHEN n * 5 >= 25 THEN 'rows' END, CASE WHEN chars >= 3000 THEN 'characters' END, CASE WHEN n * 4 >= 20 AND chars / (n * 4) >= 70 THEN 'long cells' END, CASE WHEN n / 15 >= 0.42 THEN 'narrow columns' END], lambda x: x IS NOT NULL) AS reasons FROM t""")
def dense_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.length(F.col("l_partkey").cast("string")) + 600 * (F.col("l_linenumber") % 2)).alias("chars"))
    n = F.col("n")
    return t.select("l_orderkey", tables.dense_reasons(n, n * 5, F.col("chars"), n * 4, n / 15).alias("reasons"))


# --- findings, gates, chunks ---

_FOUND = f"""WITH {LINES}, f AS (
SELECT 'caps' AS owner, doc AS file, idx AS node, 'short' AS class_id FROM lines WHERE len(text) < 60 UNION ALL SELECT 'blank', doc, idx, 'short' FROM lines WHERE len(text) < 40 UNION ALL SELECT 'blank', doc, idx, 'long' FROM lines WHERE len(text) > 2000)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    rule = lambda owner, cls, on: lines(spark, sf_dir).filter(on).select(F.lit(owner).alias("owner"), F.col("doc").alias("file"), F.col("idx").alias("node"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(cls).alias("class_id"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    return findings.unify([rule("caps", "short", n < 60), rule("blank", "short", n < 40), rule("blank", "long", n > 2000)])


@query(_FOUND + """, r AS (SELECT *, row_number() OVER (PARTITION BY file, node, class_id ORDER BY owner) AS r, count(*) OVER (PARTITION BY file, node) AS entries, min(owner) OVER (PARTITION BY file, node) <> max(owner) OVER (PARTITION BY file, node) AS two FROM f)
SELECT owner, file, node, class_id, CASE WHEN r = 1 THEN 'active' ELSE 'duplicate' END AS status, entries >= 2 AND two AS overlaps FROM r""")
def finding_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("owner", "file", "node", "class_id", "status", F.col("overlap_group").isNotNull().alias("overlaps"))


@query(_FOUND + "SELECT owner, class_id, count(*) AS n, grouping(owner, class_id)::INT AS level FROM f GROUP BY GROUPING SETS ((owner, class_id), (owner), ())")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _found(spark, sf_dir)
    return f.groupingSets([["owner", "class_id"], ["owner"], []], "owner", "class_id").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@query(_FOUND + ", r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY node, class_id, owner) AS r FROM f) SELECT owner, file, node, class_id, format('A{:04d}', r) AS id FROM r")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.numbered(_found(spark, sf_dir), ["node", "class_id", "owner"], "A", 4, ["file"]).select("owner", "file", "node", "class_id", "id")


@query(_FOUND + ", c AS (SELECT file, count(*) AS n FROM f GROUP BY file) SELECT file, least(n, 3) + CASE WHEN n > 3 THEN 1 ELSE 0 END AS listed, greatest(n - 3, 0)::BIGINT AS more FROM c")
def finding_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's listing limit: three a file, and one row that says how many more."""
    return findings.capped(_found(spark, sf_dir), ["file"], ["node", "class_id", "owner"], 3).groupBy("file").agg(F.count("*").alias("listed"), F.coalesce(F.max("more"), F.lit(0)).alias("more"))


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS fixes, count(*) FILTER (o_orderstatus <> 'F') AS open,
CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'FIXED' WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM orders GROUP BY o_custkey""")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "FIX").otherwise("PLAN").alias("action"))
    return findings.audit_status(rows, ["o_custkey"])


_COUNTS = ", ".join(f"sum(len(regexp_extract_all(coalesce(html, ''), '{p}')))::BIGINT AS {m}" for m, p in findings.METRICS.items())


@query(f"WITH g AS (SELECT page_id AS file, {_COUNTS} FROM pages GROUP BY ROLLUP(page_id)) SELECT *, CASE WHEN scripts + comments + insertions + deletions > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.gate(read(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT bool_or(regexp_matches(html, '<script|<!--|<ins[ >]|<del[ >]')) AS failed, count(*) FILTER (regexp_matches(html, '<script|<!--|<ins[ >]|<del[ >]')) AS files FROM pages")
def hard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = quality_gate(spark, sf_dir).filter("file is not null")
    return g.agg(F.bool_or(F.col("status") == "FAIL").alias("failed"), F.count_if(F.col("status") == "FAIL").alias("files"))


@query("""WITH n AS (SELECT doc_id, source, lang, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, doc_id) AS r FROM n) WHERE r = 1""".replace("\\\\", "\\"))
def license_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.sha2(F.lower(N.norm_space(F.col("text"))).cast("binary"), 256).alias("k"))
    best = d.groupBy("k").agg(F.min(F.struct("source", "doc_id")).alias("b"))  # partial aggregates instead of a window: any share of rows may be one text
    return best.select("b.doc_id", "b.source")


@query()
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.plan(lines(spark, sf_dir).withColumn("weight", F.size(similarity.words(F.col("text"))).cast("long")), 4)


@query("""WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, 4)) AS k FROM d),
e AS (SELECT doc_id, k, round_even(k * n / 4, 0)::BIGINT AS s, round_even((k + 1) * n / 4, 0)::BIGINT AS t FROM c) SELECT doc_id, k::INT AS chunk, s AS start, t AS "end" FROM e WHERE t > s""")
def even_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return chunks.even_ranges(d, "n", 4).select("doc_id", "chunk", "start", "end")


@query("""WITH x AS (SELECT DISTINCT o_custkey AS doc, o_orderkey // 32 AS idx FROM orders), g AS (SELECT doc, idx, idx - row_number() OVER (PARTITION BY doc ORDER BY idx) AS g FROM x)
SELECT doc, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY doc, g""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.floor(F.col("o_orderkey") / 32).alias("idx")).distinct()
    w = Window.partitionBy("doc").orderBy("idx")
    return x.withColumn("g", F.col("idx") - F.row_number().over(w)).groupBy("doc", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("g")


# --- rules, paragraphs, words ---


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with measures, percents and references made of line items."""
    li = read(spark, sf_dir, "lineitem")
    q, d = F.col("l_quantity").cast("int").cast("string"), F.round(F.col("l_discount") * 100).cast("int").cast("string")
    text = F.concat(F.lit("Площадь "), q, F.lit("кв.м и скидка "), d, F.lit(" % по п."), F.col("l_linenumber").cast("string"), F.lit(" договора №"), F.col("l_partkey").cast("string"))
    return li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("node"), F.col("l_partkey").alias("part"), text.alias("text"))


_MEASURES = "m AS (SELECT l_orderkey AS file, l_linenumber AS node, l_partkey AS part, CAST(l_quantity AS INT) AS q, CAST(round(l_discount * 100) AS INT) AS d FROM lineitem)"


@query(f"WITH {_MEASURES} SELECT file, node, part, 'Площадь ' || q || ' кв. м и скидка ' || d || '% по п.' || node || ' договора № ' || part AS fixed FROM m")
def rule_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import rules

    book = rules.chosen(rules.checked(rules.RULES, rules.LISTS)[0])
    return rules.fix(dealt(_measures(spark, sf_dir), "file", "node"), book, rules.LISTS).withColumnRenamed("text", "fixed")


@query(f"""WITH {_MEASURES}, f AS (SELECT file, node, part, 'AUDIT-UNIT-SQM' AS rule_code, 'PLAN' AS action, 8 AS start, 8 + len(q || 'кв.м') AS "end", q || 'кв.м' AS before, q || ' кв. м' AS after FROM m
UNION ALL SELECT file, node, part, 'AUDIT-PERCENT', 'PLAN', 8 + len(q || 'кв.м и скидка '), 8 + len(q || 'кв.м и скидка ' || d || ' %'), d || ' %', d || '%' FROM m
UNION ALL SELECT file, node, part, 'AUDIT-ABBR-REFERENCE', 'SUGGEST', 8 + len(q || 'кв.м и скидка ' || d || ' % по '), 8 + len(q || 'кв.м и скидка ' || d || ' % по п.'), 'п.', 'п. ' FROM m
UNION ALL SELECT file, node, part, 'AUDIT-NUMBER-SIGN', 'PLAN', 8 + len(q || 'кв.м и скидка ' || d || ' % по п.' || node || ' договора '), 8 + len(q || 'кв.м и скидка ' || d || ' % по п.' || node || ' договора №' || part), '№' || part, '№ ' || part FROM m)
SELECT file, node, part, rule_code, action, start::INT AS start, "end"::INT AS "end", before, after FROM f""")
def rule_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import rules

    book = rules.chosen(rules.checked(rules.RULES, rules.LISTS)[0])
    return rules.plan(dealt(_measures(spark, sf_dir), "file", "node"), book, rules.LISTS).drop("context")


@query(f"""WITH {LINES} SELECT doc, idx, CASE idx % 6 WHEN 0 THEN 'table-caption' WHEN 1 THEN CASE WHEN len({NORM.format('text')}) >= 8 THEN 'numbered-heading' END WHEN 2 THEN 'list-dash' WHEN 3 THEN 'list-number' WHEN 4 THEN CASE WHEN len({NORM.format('text')}) >= 8 THEN 'chapter' END END AS kind FROM lines WHERE regexp_matches(text, '^[A-Z][a-z]{{2,}}')""")
def paragraph_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import paragraphs

    rows = lines(spark, sf_dir).filter(F.col("text").rlike("^[A-Z][a-z]{2,}"))
    marks = F.array(*[F.lit(m) for m in ("Таблица 5 - ", "2.1 ", "- ", "3) ", "Глава 4. ", "")])
    return rows.select("doc", "idx", paragraphs.kind(F.concat(F.get(marks, F.col("idx") % 6), F.col("text"))).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'skip_first_two_pages' WHEN l_quantity <= 3 THEN 'too_few_columns' WHEN l_partkey % 10 <= 2 THEN 'too_few_rows' WHEN l_suppkey % 5 < 2 THEN 'too_few_data_rows' ELSE 'ok' END AS reason FROM lineitem""")
def fit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import paragraphs

    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", paragraphs.fit_gate(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_partkey") % 10, F.lit(1), F.col("l_suppkey") % 5, 3).alias("reason"))


@query("""WITH s AS (SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS section, l_returnflag || l_linestatus AS p FROM lineitem), v AS (SELECT doc, p, count(*) AS n, min(section) AS f FROM s GROUP BY 1, 2),
u AS (SELECT doc, p AS usual FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) AS r FROM v) WHERE r = 1) SELECT doc, section, p AS profile FROM s JOIN u USING (doc) WHERE p <> usual""")
def section_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import paragraphs

    s = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("section"), F.concat("l_returnflag", "l_linestatus").alias("profile"))
    return paragraphs.profile_changes(s, "profile").select("doc", "section", "profile")


@query("""WITH s AS (SELECT o_custkey AS doc, o_orderkey AS section, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT doc, section, CASE WHEN r = 1 THEN 'page-number-first-section-start' ELSE 'page-number-section-restart' END AS class_id FROM s WHERE p IS NOT NULL AND (r > 1 OR p <> 1)""")
def page_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import paragraphs

    s = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("section"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).alias("page_start"))
    return paragraphs.page_restarts(s).select("doc", "section", "class_id")


@query("""SELECT c_custkey, lower('г. ' || c_mktsegment) AS locality, 'ул.' AS street_type, lower(c_mktsegment) AS street, CAST(c_nationkey AS VARCHAR) AS house, 'к' || (c_custkey % 9 + 1) AS mods FROM customer""")
def address_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import address

    c = read(spark, sf_dir, "customer")
    text = F.concat(F.lit("город "), "c_mktsegment", F.lit(", улица "), "c_mktsegment", F.lit(", дом "), F.col("c_nationkey").cast("string"), F.lit(" корпус "), (F.col("c_custkey") % 9 + 1).cast("string"))
    return c.select("c_custkey", address.parsed(text).alias("a")).select("c_custkey", *[f"a.{f}" for f in ("locality", "street_type", "street", "house", "mods")])


@query("""SELECT l_orderkey, 'Строение № ' || l_partkey || ' и здания' AS after, 1 AS hits FROM lineitem""")
def morph_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.operators import morph

    lexicon = spark.createDataFrame([("дом", "дом", ["nomn"]), ("дома", "дом", ["gent"]), ("строение", "строение", ["nomn"]), ("строения", "строение", ["gent"])], "form string, lemma string, grammemes array<string>")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("Дом № "), F.col("l_partkey").cast("string"), F.lit(" и здания")).alias("text"))
    return morph.replace_in(rows, "дома", "строение", lexicon).select("l_orderkey", "after", "hits")


@query("""WITH t AS (SELECT l_orderkey AS doc, min(l_linenumber) AS first, list(l_linenumber ORDER BY l_linenumber) AS members, count(*) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT doc, first::INT AS first, members, (k + 1)::INT AS n_rows, (k - 1)::INT AS dropped FROM t""")
def table_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as tables of a header and a row, stitched."""
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = F.array(F.array(F.lit("line"), F.lit("value")), F.array(F.col("l_linenumber").cast("string"), F.lit("x")))
    return tables.stitch_tables(t.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("table_index"), F.lit(2).alias("width"), F.lit("").alias("style"), F.lit(5000).alias("total"), F.lit(False).alias("text_before"), rows.alias("rows")))


@query("SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 20")
def top_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the twenty places with the most rows."""
    d = read(spark, sf_dir, "documents").filter("source is not null")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang").limit(20)


@query("SELECT l_shipmode AS style, kind, count(*) AS uses, min(o) AS first_use FROM (SELECT l_returnflag AS l_shipmode, l_linestatus AS kind, l_orderkey AS o FROM lineitem) GROUP BY 1, 2")
def style_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("style"), F.col("l_linestatus").alias("kind")).agg(F.count("*").alias("uses"), F.min("l_orderkey").alias("first_use"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [['Отчет', ''], ['Имя', 'Сумма'], ['1', '2']] WHEN 1 THEN [['Имя', 'Сумма'], ['1', '2']] WHEN 2 THEN [['1', '2']] ELSE [['Имя', 'Сумма'], ['', '']] END AS g FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 1 END AS headers, CASE o_orderkey % 4 WHEN 0 THEN 1 ELSE 0 END AS preheaders FROM o""")
def header_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    grid = lambda *rows: F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    k, head, one = F.col("o_orderkey") % 4, ("Имя", "Сумма"), ("1", "2")
    g = F.when(k == 0, grid(("Отчет", ""), head, one)).when(k == 1, grid(head, one)).when(k == 2, grid(one)).otherwise(grid(head, ("", "")))
    o = o.select("o_orderkey", g.alias("g")).withColumn("headers", tables.header_rows(F.col("g")))
    return o.select("o_orderkey", "headers", tables.preheader_rows(F.col("g"), F.col("headers")).alias("preheaders"))


@query("""SELECT c_custkey, replace(c_name || '|' || c_mktsegment, '|', chr(92) || '|') AS escaped, CASE WHEN length(c_name) <= 10 THEN c_name ELSE left(c_name, 7) || '...' END AS short FROM customer""")
def report_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", N.md_escape(F.concat("c_name", F.lit("|"), "c_mktsegment")).alias("escaped"), N.truncate(F.col("c_name"), 10).alias("short"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.995 THEN 'normalised duplicate' WHEN n > 0 AND r / n >= 0.8 AND d <= 2 THEN 'linked versions' WHEN (n > 0 AND r / n >= 0.5) OR s >= 0.55 THEN 'similar candidate' WHEN n - r > 0 OR d > 0 THEN 'weak candidate' ELSE 'overall similarity' END AS recommendation
FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s, l_linenumber AS r, CAST(l_quantity AS INT) % 10 AS n, CAST(l_quantity AS INT) % 4 AS d FROM lineitem)""")
def pair_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    r, n, d, s = F.col("l_linenumber"), q % 10, q % 4, F.col("l_discount") * 10
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", similarity.recommendation(s, s, r, n - r, d, n).alias("recommendation"))
