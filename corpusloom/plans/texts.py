"""Registered queries on texts and tables made of rows in a known way, so that SQL can tell what each operator must find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.operators import address, alignment, findings, hygiene, reconcile, rules, similarity, structure, tables
from corpusloom.plans.registered import dealt, query, read

_LINES = "lines AS (SELECT doc_id AS doc, (i - 1)::INT AS idx, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


def _untidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with one finding of each class."""
    li = read(spark, sf_dir, "lineitem")
    q, p = F.col("l_quantity").cast("int").cast("string"), F.col("l_partkey").cast("string")
    text = F.concat(F.lit("Сумма  "), q, F.lit(" ,итог: "), p, F.lit(" шту­к.Далее руб.нет"))
    return li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("node"), text.alias("text"))


_UNTIDY = "u AS (SELECT l_orderkey AS file, l_linenumber AS node, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p, len(CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS a, len(CAST(l_partkey AS VARCHAR)) AS b FROM lineitem)"


@query(f"""WITH {_UNTIDY}, f AS (SELECT file, node, 'double_space' AS class_id, 5 AS s, 7 AS e, '  ' AS before, ' ' AS after FROM u UNION ALL SELECT file, node, 'space_before_punct', 7 + a, 9 + a, ' ,', ',' FROM u
UNION ALL SELECT file, node, 'missing_after_punct', 8 + a, 9 + a, ',', ', ' FROM u UNION ALL SELECT file, node, 'soft_hyphen', 19 + a + b, 20 + a + b, chr(173), '' FROM u UNION ALL SELECT file, node, 'missing_after_dot', 21 + a + b, 22 + a + b, '.', '. ' FROM u)
SELECT file, node, class_id, s::INT AS start, e::INT AS "end", before, after FROM f""")
def hygiene_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hygiene.scan(dealt(_untidy(spark, sf_dir), "file", "node"), check_dot=True).select("file", "node", "class_id", "start", "end", "before", "after")


@query(f"WITH {_UNTIDY} SELECT file, node, 'Сумма ' || q || ', итог: ' || p || ' шту' || chr(173) || 'к. Далее руб.нет' AS fixed FROM u")
def hygiene_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft hyphens stay; an abbreviation's dot takes no space."""
    return _untidy(spark, sf_dir).select("file", "node", hygiene.fix(F.col("text"), True).alias("fixed"))


@query("SELECT l_orderkey, l_linenumber, 'Всего, рублей ' || CAST(l_quantity AS INT) || ', ООО ромашка, IV квартал,не Так, ЖКХ' AS after FROM lineitem")
def comma_lowercase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first capitalised word after a comma, over acronyms and Roman numerals."""
    li = read(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("Всего, Рублей "), F.col("l_quantity").cast("int").cast("string"), F.lit(", ООО Ромашка, IV Квартал,не Так, ЖКХ"))
    rows = dealt(li.select("l_orderkey", "l_linenumber", text.alias("text")), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", hygiene.lowercase_after_comma(F.col("text")).alias("after"))


@query(f"""WITH {_UNTIDY}, f AS (SELECT file, node, 'double_space' AS class_id FROM u UNION ALL SELECT file, node, 'space_before_punct' FROM u UNION ALL SELECT file, node, 'missing_after_punct' FROM u UNION ALL SELECT file, node, 'soft_hyphen' FROM u)
SELECT 'text_hygiene' AS owner, file, node, class_id, 'active' AS status, count(*) AS n FROM f GROUP BY ALL""")
def deep_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hygiene, rules and their union: the untidy sentences break no rule of the books."""
    from corpusloom.plans import pipelines

    found = pipelines.deep_hygiene(dealt(_untidy(spark, sf_dir), "file", "node"))
    return found.groupBy("owner", "file", "node", "class_id", "status").agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT doc, 'deleted' AS change, idx AS a_ordinal, NULL::INT AS b_ordinal FROM lines WHERE idx % 5 = 0 AND idx + 1 <= (SELECT count(*) FROM lines l WHERE l.doc = lines.doc)")
def document_block_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its copy without the lines whose numbers 5 divides: changed blocks by their keys, which a line's number makes unlike any other."""
    key = F.sha2(F.concat_ws("|", F.col("idx").cast("string"), N.norm_space(F.col("text"))).cast("binary"), 256)
    rows = similarity.normal_lines(read(spark, sf_dir, "documents")).select("doc", F.col("idx").alias("ordinal"), key.alias("key"))
    return similarity.sequence_diff(rows, rows.filter("ordinal % 5 <> 0"), ["doc"])


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of section titles that agree in different ways, by the customer's key."""
    kinds = [
        ("Зона (Ж-1)", "Зона (Ж-1)"), ("Зона (Ж-1)", "Зона (Ж-1) (О 2)"), ("Жилая зона (Ж-1)", "Зона жилая (Ж 1)"), ("Общие нормы", "Общие нормы"), ("Общие нормы", "Нормы общие"),
        ("Территория застройки (Ж-1)", "Территории застройки (Ж-1)"), ("Первое", "Второе"), (None, "Второе"),
    ]
    pick = lambda i: F.get(F.array(*[F.lit(k[i]) for k in kinds]), (F.col("c_custkey") % 8).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", pick(0).alias("a_title"), pick(1).alias("b_title"), (F.col("c_nationkey") / 25.0).alias("similarity"))


@query("""WITH c AS (SELECT c_custkey, c_custkey % 8 AS k, c_nationkey / 25.0 AS s FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'совпал заголовок и код зоны: Ж1' WHEN 1 THEN 'совпала основа заголовка и код зоны: Ж1' WHEN 2 THEN 'совпал код зоны и набор слов заголовка: Ж1' WHEN 3 THEN 'совпал заголовок' WHEN 4 THEN 'совпал набор слов заголовка'
WHEN 5 THEN 'совпал код зоны и близкий заголовок: Ж1' WHEN 7 THEN 'раздел без пары' ELSE CASE WHEN s >= 0.8 THEN 'высокая похожесть содержимого' WHEN s >= 0.55 THEN 'средняя похожесть содержимого' ELSE 'низкая похожесть содержимого' END END AS reason,
CASE WHEN k = 7 THEN 'нет пары' WHEN k < 6 OR s >= 0.8 THEN 'уверенно' WHEN s >= 0.55 THEN 'проверить' ELSE 'сомнительно' END AS confidence FROM c""")
def section_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten reasons and four levels of confidence."""
    return alignment.identity(_titles(spark, sf_dir)).select("c_custkey", "reason", "confidence")


@query("""WITH c AS (SELECT o_custkey AS doc, count(*) AS n FROM orders GROUP BY 1) SELECT doc, (CASE WHEN n = 1 THEN 1 ELSE 0 END)::INT AS changed, (CASE WHEN n = 1 THEN 0 ELSE 1 END)::INT AS inserted, (CASE WHEN n = 1 THEN 0 ELSE 1 END)::INT AS deleted, (CASE WHEN n = 1 THEN 1 ELSE 2 END)::INT AS examples FROM c""")
def table_change_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a table, against the same without its first row and with a new last one."""
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("k"))
    grid = F.transform("k", lambda x: F.array(x.cast("string"), F.lit("x")))
    other = F.concat(F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), F.array(F.array(F.lit("new"), F.lit("x"))))
    t = rows.select("doc", alignment.table_change(grid, other).alias("t"))
    return t.select("doc", "t.changed", "t.inserted", "t.deleted", F.size("t.examples").alias("examples"))


@query("""SELECT c_custkey, ['equal', 'delete', 'insert', 'equal'] AS ops, ['Сегмент ', c_mktsegment, c_mktsegment || '2', ' сегодня'] AS texts, ['--- a', '+++ b', '@@ -1,3 +1,3 @@', ' a', '-' || c_mktsegment, '+' || c_mktsegment || '2', ' b'] AS lines FROM customer""")
def redline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word changed in a text, as segments and as a unified diff of lines."""
    seg, new = F.col("c_mktsegment"), F.concat("c_mktsegment", F.lit("2"))
    text = lambda x: F.concat(F.lit("Сегмент "), x, F.lit(" сегодня"))
    c = read(spark, sf_dir, "customer").select("c_custkey", alignment.redlines(text(seg), text(new)).alias("r"), alignment.unified(F.concat(F.lit("a\n"), seg, F.lit("\nb")), F.concat(F.lit("a\n"), new, F.lit("\nb"))).alias("lines"))
    return c.select("c_custkey", F.col("r.op").alias("ops"), F.col("r.text").alias("texts"), "lines")


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders), g AS (SELECT doc, count(*) AS n, max(k) AS top FROM o GROUP BY doc)
SELECT doc, 1 AS a_section, 1 AS b_section, 'deleted' AS change, r::INT AS a_ordinal, NULL::INT AS b_ordinal FROM o WHERE r % 3 = 0 UNION ALL SELECT doc, 2, NULL, 'deleted', 1, NULL FROM g UNION ALL SELECT doc, NULL, 3, 'inserted', NULL, 1 FROM g""")
def section_wise_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched section that lost every third block, a section without a match on either side."""
    from pyspark.sql.window import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("section"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ordinal"), F.col("o_orderkey").cast("string").alias("key"))
    one = o.select("doc").distinct()
    lone = lambda section, key: one.select("doc", F.lit(section).alias("section"), F.lit(1).alias("ordinal"), F.lit(key).alias("key"))
    pairs = one.select("doc", F.explode(F.array(*[F.struct(F.lit(a).cast("int").alias("a_section"), F.lit(b).cast("int").alias("b_section")) for a, b in ((1, 1), (2, None), (None, 3))])).alias("m")).select("doc", "m.*")
    return alignment.section_changes(o.unionByName(lone(2, "gone")), o.filter("ordinal % 3 <> 0").unionByName(lone(3, "new")), pairs, ["doc"])


def _order_tables(spark: SparkSession, sf_dir: str, rows) -> DataFrame:
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return t.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("table_index"), F.lit(2).alias("width"), F.lit("").alias("style"), F.lit(5000).alias("total"), F.lit(False).alias("text_before"), rows.alias("rows"))


@query("""WITH t AS (SELECT l_orderkey AS doc, list(l_linenumber ORDER BY l_linenumber) AS m, min(l_linenumber) AS f FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1)
SELECT doc, f::INT AS first, m AS members, [['Отчет', ''], ['имя', 'сумма']] || list_transform(m, lambda x: [CAST(x AS VARCHAR), 'x']) AS rows, (len(m) - 1)::INT AS dropped FROM t""")
def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of an order whose later pages repeat the header below a preheader."""
    n = F.col("l_linenumber")
    row = F.array(n.cast("string"), F.lit("x"))
    head = F.array(F.lit("имя"), F.lit("сумма"))
    first = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("f"))
    t = _order_tables(spark, sf_dir, F.array(head, row)).join(first.withColumnRenamed("l_orderkey", "doc"), "doc")
    t = t.withColumn("rows", F.when(F.col("table_index") == F.col("f"), F.concat(F.array(F.array(F.lit("Отчет"), F.lit(""))), F.col("rows"))).otherwise(F.col("rows"))).drop("f")
    return tables.running_tables(t)


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS i FROM lineitem), g AS (SELECT doc, i, sum((p IS NULL OR (i % 3 = 0) <> (p % 3 = 0))::INT) OVER (PARTITION BY doc ORDER BY i) AS g FROM (SELECT doc, i, lag(i) OVER (PARTITION BY doc ORDER BY i) AS p FROM t))
SELECT doc, min(i)::INT AS first, list(i ORDER BY i) AS members FROM g GROUP BY doc, g""")
def table_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third table has another header, so that it stands with its like alone."""
    i = F.col("l_linenumber")
    head = F.when(i % 3 == 0, F.array(F.lit("совсем"), F.concat(F.lit("другое"), i.cast("string")))).otherwise(F.array(F.lit("имя"), F.lit("сумма")))
    return tables.grouped_tables(_order_tables(spark, sf_dir, F.array(head)), "safe")


@query("SELECT p_partkey, p_size >= 25 AS numeric, p_size < 25 AS record_number, p_size % 2 = 0 AS index_like, p_size % 3 = 0 AS section FROM part")
def cell_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads as a number, as a record's number, as an index, and which rows open a section."""
    p, n = read(spark, sf_dir, "part"), F.col("p_size")
    number = F.when(n >= 25, F.concat(n.cast("string"), F.lit(",5 %"))).otherwise(F.concat(n.cast("string"), F.lit(".1")))
    index = F.when(n % 2 == 0, F.concat(n.cast("string"), F.lit("-1 ."))).otherwise(F.col("p_name"))
    row = F.when(n % 3 == 0, F.array(F.col("p_name"), F.lit(" "), F.lit(None))).otherwise(F.array(F.col("p_name"), F.lit("x"), F.lit(None)))
    return p.select("p_partkey", (tables.looks_numeric(number) & (n >= 25)).alias("numeric"), tables.looks_record_number(number).alias("record_number"), tables.looks_index(index).alias("index_like"), tables.section_row(row).alias("section"))


@query("SELECT s, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT n_name AS s, n_nationkey % 3 <> 0 AS a, n_nationkey % 5 <> 0 AS b FROM nation) WHERE a OR b")
def sheet_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumnRenamed("n_name", "s")
    return reconcile.sheet_sets(n.filter("n_nationkey % 3 <> 0"), n.filter("n_nationkey % 5 <> 0"), "s")


@query("SELECT c_custkey, 'Узел ' || c_custkey || ' ⟦A0001 X⟧ ⟦A0002 Y⟧' AS marked, 'Узел ' || c_custkey AS stripped FROM customer")
def audit_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c).alias("rule_code")) for i, c in (("A0001", "X"), ("A0002", "Y"))])
    marked = rules.anchor(F.concat(F.lit("Узел "), F.col("c_custkey").cast("string")), marks)
    return read(spark, sf_dir, "customer").select("c_custkey", marked.alias("marked"), rules.strip_anchors(marked).alias("stripped"))


@query("""WITH a AS (SELECT c_nationkey AS block, 'ул ' || lower(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY ALL) SELECT block, name, lower(c_mktsegment) || ' ул' AS candidate, 1 AS rank FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) k JOIN a ON a.block = k.c_nationkey AND a.name = 'ул ' || lower(c_mktsegment)""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street names in another order of words find each other within their block only."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("block"), F.lower("c_mktsegment").alias("s")).distinct()
    return address.fuzzy_candidates(c.select("block", F.concat(F.lit("ул "), "s").alias("name")), c.select("block", F.concat("s", F.lit(" ул")).alias("name")), "block", "name", cutoff=99.0).select("block", "name", "candidate", "rank")


@query("""SELECT c_custkey, c_nationkey % 2 = 0 AS strict, c_nationkey % 2 = 0 OR c_nationkey % 4 = 1 AS relaxed FROM customer""")
def same_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House and modifiers equal; a missing modifier counts as none only in the relaxed comparison."""
    k = F.col("c_nationkey")
    a = F.struct(k.cast("string").alias("house"), F.when(k % 2 == 0, F.lit("к1")).alias("mods"))
    b = F.struct(k.cast("string").alias("house"), F.when(k % 2 == 0, F.lit("к1")).when(k % 4 == 1, F.lit("")).otherwise("к2").alias("mods"))
    return read(spark, sf_dir, "customer").select("c_custkey", address.same_house(a, b).alias("strict"), address.same_house(a, b, strict=False).alias("relaxed"))


@query("""SELECT c_custkey, (CASE WHEN c_nationkey < 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS sets, (CASE WHEN c_nationkey < 5 THEN 1.0 WHEN c_nationkey < 10 THEN 0.0 ELSE round(1.0 / 3, 6) END)::DOUBLE AS jaccard, (CASE WHEN c_nationkey < 5 THEN 0 ELSE 2 END)::INT AS shingles FROM
(SELECT c_custkey, c_nationkey FROM customer)""")
def set_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard of sets, of which both, one or none are empty; shingles of a section shorter than a shingle are its words."""
    k, none = F.col("c_nationkey"), F.array().cast("array<string>")
    a = F.when(k < 10, none).otherwise(F.array(F.lit("x"), F.lit("y")))
    b = F.when(k < 5, none).otherwise(F.array(F.lit("y"), F.lit("z")))
    text = F.when(k < 5, F.lit("")).otherwise(F.lit("два слова"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.when(k < 5, 1.0).otherwise(0.0).alias("sets"), F.round(similarity.jaccard(a, b), 6).alias("jaccard"), F.size(similarity.section_shingles(similarity.words(text))).alias("shingles"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS idx, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), b AS (SELECT *, CASE WHEN doc % 3 = 0 THEN 'heading-style' WHEN doc % 3 = 1 AND (n + 1) // 2 >= 2 THEN 'numbered-text' ELSE 'single-section' END AS basis FROM o),
s AS (SELECT *, sum((r = 1 OR (basis = 'heading-style' AND r % 3 = 1) OR (basis = 'numbered-text' AND r % 2 = 1))::INT) OVER (PARTITION BY doc ORDER BY idx) AS section FROM b) SELECT doc, section::BIGINT AS section, basis, min(idx) AS first, count(*) AS n FROM s GROUP BY doc, section, basis""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut by heading styles, by numbered lines, or not at all."""
    from pyspark.sql.window import Window

    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("idx"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"))
    text = F.when((F.col("doc") % 3 == 1) & (F.col("r") % 2 == 1), F.concat(F.col("r").cast("string"), F.lit(". Раздел"))).otherwise(F.lit("текст"))
    return structure.numbered_sections(o.select("doc", "idx", text.alias("text"), ((F.col("doc") % 3 == 0) & (F.col("r") % 3 == 1)).alias("is_heading")))


@query("SELECT format('U{:06d}', row_number() OVER (ORDER BY o_orderkey, o_custkey)) AS id, o_orderkey FROM orders")
def global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over all rows in order, without gathering them in one task."""
    return findings.numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey", "o_custkey"], "U", 6).select("id", "o_orderkey")
