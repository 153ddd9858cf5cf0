"""Text corpus queries: documents, benchmark passages, and pipe tables made of order lines."""

from pyspark.sql import functions as F

from ..operators import corpus as k
from ..shared import deal, parts_of
from .explore import t

QUERIES = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(r"""SELECT doc_id, CAST((length(x) - length(replace(x, '\$', ''))) / 2 AS BIGINT) AS n_dollars, CAST(2 * (length(text) - length(replace(text, '. ', '.'))) AS BIGINT) AS n_commands,
sha256(replace(replace(replace(x, '\$', '&#36;'), '\textless!', '<!'), '\textellipsis!', '\ldots!')) AS digest FROM (SELECT doc_id, text, replace(replace(text, '$', '\$'), '. ', '.\textless!\textellipsis! ') AS x FROM documents)""")
def repair_markdown(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.replace(F.replace("text", F.lit("$"), F.lit("\\$")), F.lit(". "), F.lit(".\\textless!\\textellipsis! ")).alias("text"))
    return k.repair_markdown(docs, "text").select("doc_id", "n_dollars", "n_commands", F.sha2("text", 256).alias("digest"))


@query("""SELECT page_id, 'heated to ' || (page_id % 90) || ' °C and ' || CASE WHEN page_id % 2 = 0 THEN '2' || (page_id % 10) || ' °C' ELSE '$x_1$' END || ' then T = -5 °K.' AS text, CAST(CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS BIGINT) AS n_degrees, CAST(CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_inferred FROM pages""")
def normalise_degrees(spark, sf):
    p = F.col("page_id")
    text = F.concat(F.lit("heated to $"), (p % 90).cast("string"), F.lit(r"^{\circ}\mathrm{C}$ and "), F.when(p % 2 == 0, F.concat(F.lit("$2 "), (p % 10).cast("string"), F.lit(r" ^{0} \mathrm{C}$"))).otherwise(F.lit("$x_1$")), F.lit(r" then $T = - 5 ^\circ K .$"))
    return k.normalise_degrees(t(spark, sf, "pages").select("page_id", text.alias("text")), "text", "page_id").select("page_id", F.regexp_replace("text", r" °K\.$", " °K.").alias("text"), "n_degrees", "n_inferred")


@query("SELECT page_id, page_id % 3 <> 1 AS digits_ok FROM pages")
def digit_guard(spark, sf):
    p = F.col("page_id")
    before = F.concat(F.lit("at 12 and 300 x"), (p + 11).cast("string"))
    after = F.when(p % 3 == 0, F.concat(F.lit("12 3 "), (p + 11).cast("string"))).when(p % 3 == 1, F.concat(F.lit("12 3 1"), (p + 11).cast("string"))).otherwise(before)
    return k.digit_guard(t(spark, sf, "pages").select("page_id", before.alias("b"), after.alias("a")), "b", "a").select("page_id", "digits_ok")


def query_all(sql):
    """The query under its name and under NAME_all, as which it was first registered over all rows."""

    def add(f):
        QUERIES[f.__name__] = QUERIES[f"{f.__name__}_all"] = (f, sql)
        return f

    return add


def _tables(spark, sf):
    """One pipe table per order: a header, a separator, a row per line; some headers name a curve."""
    line = F.concat(F.lit("| "), F.col("l_linenumber").cast("string"), F.lit(" | "), F.format_string("%.2f", F.col("l_extendedprice")), F.when(F.col("l_partkey") % 2 == 0, " ~ |").otherwise(" | "), F.when(F.col("l_partkey") % 3 == 0, " 123456 |").otherwise(" |"))
    lines = t(spark, sf, "lineitem")
    rows = deal(lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey"), parts_of(lines), "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("rows"))
    head = F.when(F.col("l_orderkey") % 2 == 0, "| curve | y | z |").otherwise("| x | y | z |")
    return rows.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("Order\n"), head, F.lit("\n|---|---|---|\n"), F.col("rows"), F.lit("\n\nand $$x^2$$ done")).alias("text"))


@query_all("""WITH l AS (SELECT l_orderkey AS doc, count(*) AS n, count(*) FILTER (WHERE l_partkey % 2 = 0) AS tildes, count(*) FILTER (WHERE l_partkey % 3 = 0) AS long, sum(length(CAST(l_linenumber AS VARCHAR)) + length(printf('%.2f', l_extendedprice)) + CASE WHEN l_partkey % 2 = 0 THEN 4 ELSE 3 END + CASE WHEN l_partkey % 3 = 0 THEN 9 ELSE 2 END + 5) AS size FROM lineitem GROUP BY 1)
SELECT doc, CAST(1 AS BIGINT) AS tables, CAST(n AS BIGINT) AS table_rows, CAST(2 * n + long AS BIGINT) AS table_numbers, CAST(long AS BIGINT) AS concat_cells, CAST(1 AS BIGINT) AS display_formulas,
CAST(CASE WHEN doc % 2 = 0 OR 2 * tildes > n THEN n ELSE 0 END AS BIGINT) AS chart_rows, CAST(2 * n + long + 1 AS BIGINT) AS numbers_total FROM l""")
def content_metrics(spark, sf):
    return k.content_metrics(_tables(spark, sf), "text", "doc").drop("chars")


@query_all("""SELECT doc, number, CAST(count(*) AS BIGINT) AS n FROM (SELECT l_orderkey AS doc, printf('%.2f', l_extendedprice) AS number FROM lineitem) GROUP BY 1, 2""")
def numbers(spark, sf):
    return k.numbers(_tables(spark, sf), "text", "doc")


@query_all("""WITH c AS (SELECT l_orderkey AS doc, l_quantity || '.5' AS number, count(*) AS n FROM (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem) GROUP BY 1, 2), p AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders),
u AS (SELECT a, b, number, n AS na, 0 AS nb FROM p JOIN c ON c.doc = a UNION ALL SELECT a, b, number, 0, n FROM p JOIN c ON c.doc = b)
SELECT a, b, number, CAST(greatest(sum(na) - sum(nb), 0) AS BIGINT) AS only_a, CAST(greatest(sum(nb) - sum(na), 0) AS BIGINT) AS only_b FROM u GROUP BY 1, 2, 3 HAVING sum(na) <> sum(nb)""")
def exclusive_numbers(spark, sf):
    text = F.array_join(F.collect_list(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".5"))), " ")
    lines = t(spark, sf, "lineitem")
    docs = deal(lines.select("l_orderkey", "l_quantity"), parts_of(lines), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc")).agg(text.alias("text"))
    pairs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"))
    return k.exclusive_numbers(pairs, k.numbers(docs, "text", "doc"), "a", "b", "doc").withColumns({c: F.col(c).cast("long") for c in ("only_a", "only_b")})


@query()
def text_similarity(spark, sf):
    turns = t(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", F.col("text").alias("a"), F.reverse("text").alias("b"))
    return k.text_similarity(turns, "a", "b").select("conv_id", "turn", "similarity")


MARKED = "(SELECT doc_id, '<!-- page ' || 1 || ' of 3 -->' || '\nTable IV. Values\n' || text || '\n<!-- page 2 of 3 -->\nFig. 7 The curve\n<!--page 3 of 3-->\n' || CAST(doc_id AS VARCHAR) AS text FROM documents)"


def _marked(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.concat(F.lit("<!-- page 1 of 3 -->\nTable IV. Values\n"), F.coalesce("text", F.lit("")), F.lit("\n<!-- page 2 of 3 -->\nFig. 7 The curve\n<!--page 3 of 3-->\n"), F.col("doc_id").cast("string")).alias("text"))


@query("""SELECT doc_id, unnest([0, 1, 2, 3])::INTEGER AS part, unnest([NULL, 1, 2, 3])::INTEGER AS page, 3::INTEGER AS pages, unnest([0, 19 + length(coalesce(text, '')), 18, 1 + length(CAST(doc_id AS VARCHAR))])::BIGINT AS size FROM documents""")
def page_index(spark, sf):
    return k.page_index(_marked(spark, sf), "text", "doc_id").select("doc_id", F.col("part").cast("int").alias("part"), "page", "pages", F.char_length("body").cast("long").alias("size"))


@query("""SELECT page_id, CAST(i AS BIGINT) AS at, 'doc:x/page:' || (i + 1) || '/block:' || page_id AS path, CAST(i + 1 AS INTEGER) AS page, CAST(page_id AS INTEGER) AS block, CASE WHEN i = 0 THEN 'Figure 3 shows it' ELSE NULL END AS caption FROM pages, (VALUES (0), (1)) AS v(i)""")
def figure_captions(spark, sf):
    p = F.col("page_id").cast("string")
    mark = lambda i: F.concat(F.lit(f"![Image](doc:x/page:{i}/block:"), p, F.lit(")"))
    text = F.concat(F.lit("start "), mark(1), F.lit("\nwords\n**Figure 3 shows it\n\n"), mark(2), F.lit("\nno caption here\n"))
    return k.figures(t(spark, sf, "pages").select("page_id", text.alias("text")), "text", "page_id")


PLAIN = "regexp_replace(lower(regexp_replace(regexp_replace({}, '</?[a-zA-Z][^<>]*>', ' ', 'g'), '\\\\[a-zA-Z]+', '', 'g')), '[^0-9a-z]', '', 'g')"


def _quotes(spark, sf):
    """Of each document whose words allow it: ten words of its own, the same with a letter of each third
    word changed, ten words of the next document, and a benchmark passage."""
    docs = t(spark, sf, "documents").select("doc_id", "text")
    words = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    ten = docs.filter("text is not null").select("doc_id", F.array_join(F.slice(words, 4, 10), " ").alias("said"))
    spoilt = F.array_join(F.transform(F.split("said", " "), lambda w, i: F.when((i % 9 == 4) & (F.length(w) > 3), F.concat(F.left(w, F.lit(2)), F.lit("q"), F.substring(w, F.lit(4), F.length(w)))).otherwise(w)), " ")
    own = ten.select("doc_id", F.posexplode(F.array(F.col("said"), spoilt)).alias("quote_no", "quote"))
    other = ten.select((F.col("doc_id") - 1).alias("doc_id"), F.lit(2).alias("quote_no"), F.col("said").alias("quote"))
    passages = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    shared = docs.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(passages, "item_id").select("doc_id", F.lit(3).alias("quote_no"), "quote")
    return own.unionByName(other).unionByName(shared), docs


@query(f"""WITH w AS (SELECT doc_id, list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 4, 13) AS ws FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, array_to_string(ws, ' ') AS said, ws FROM w),
q AS (SELECT doc_id, 0 AS quote_no, said AS quote FROM s UNION ALL
SELECT doc_id, 1, array_to_string([CASE WHEN (i - 1) % 9 = 4 AND length(ws[i]) > 3 THEN left(ws[i], 2) || 'q' || ws[i][4:] ELSE ws[i] END for i in range(1, len(ws) + 1)], ' ') FROM s UNION ALL
SELECT doc_id - 1, 2, said FROM s UNION ALL SELECT doc_id, 3, benchmark.text FROM documents JOIN benchmark ON doc_id % 40 = item_id),
p AS (SELECT q.doc_id, quote_no, {PLAIN.format("quote")} AS a, {PLAIN.format("string_split(trim(quote), ' ')[1]")} AS l, {PLAIN.format("regexp_replace(trim(quote), '^\\S*\\s*', '')")} AS r, {PLAIN.format("coalesce(d.text, '')")} AS t FROM q LEFT JOIN documents d ON q.doc_id = d.doc_id)
SELECT doc_id, CAST(quote_no AS INTEGER) AS quote_no, 'exact' AS found FROM p WHERE (length(a) >= 8 AND contains(t, a)) OR (length(l) >= 2 AND contains(t, l) AND length(r) >= 8 AND contains(t, r))""")
def verify_quotes(spark, sf):
    """The quotes that stand in their documents word for word."""
    quotes, docs = _quotes(spark, sf)
    return k.verify_quotes(quotes, docs, "text", "doc_id").filter("found = 'exact'").select("doc_id", "quote_no", "found")


@query()
def near_quotes(spark, sf):
    """All quotes, with what was found: exact, near or none."""
    quotes, docs = _quotes(spark, sf)
    return k.verify_quotes(quotes, docs, "text", "doc_id").select("doc_id", "quote_no", "found")


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE NULL END::INTEGER AS found_page FROM documents""")
def resolve_sources(spark, sf):
    d = F.col("doc_id") % 4
    points = t(spark, sf, "documents").select(
        "doc_id", F.lit(0).alias("point"), F.lit("table").alias("kind"), F.when(d == 0, "Table IV").when(d == 1, "Figure 7").alias("label"), F.when(d == 2, 2).when(d == 3, 9).alias("page"), F.lit(None).cast("string").alias("quote")
    )
    return k.resolve_sources(points, _marked(spark, sf), "text", "doc_id").select("doc_id", "found_page")


@query()
def resolve_sources_all(spark, sf):
    """All legs: a recorded figure without a caption line, caption lines, a quote of the text, a quote
    whose end is spelt differently, a given page."""
    d = F.col("doc_id") % 6
    docs = _marked(spark, sf)
    words = F.slice(F.split(F.trim(F.regexp_replace("body", r"\s+", " ")), " "), 1, 12)
    quotes = k.page_index(docs, "text", "doc_id").filter("part = 1").select("doc_id", F.array_join(F.slice(words, 4, 9), " ").alias("said"))
    points = docs.join(quotes, "doc_id", "left").select(
        "doc_id", F.lit(0).alias("point"), F.lit("figure").alias("kind"), F.when(d == 0, "Figure 3").when(d == 1, "Fig. 7").when(d == 2, "Table IV").alias("label"), F.when(d == 5, 2).otherwise(9).alias("page"),
        F.when(d == 3, F.col("said")).when(d == 4, F.concat("said", F.lit(" $x$"))).alias("quote"),
    )
    recorded = docs.filter(d < 2).select("doc_id", F.lit(0).alias("at"), F.lit(3).alias("page"), F.when(d == 0, "Fig. 3. The curve").otherwise("Fig. 70").alias("caption"))
    return k.resolve_sources(points, docs, "text", "doc_id", recorded).select("doc_id", "found_page")


@query("""SELECT page_id, 'a ![x](new' || page_id || ') b ![y](other) c' AS text FROM pages""")
def rewrite_figures(spark, sf):
    p = F.col("page_id").cast("string")
    docs = t(spark, sf, "pages").select("page_id", F.concat(F.lit("a ![x](old"), p, F.lit(") b ![y](other) c")).alias("text"))
    figures = t(spark, sf, "pages").select("page_id", F.concat(F.lit("old"), p).alias("locator"), F.concat(F.lit("new"), p).alias("path"))
    return k.rewrite_figures(docs, figures, "text", "page_id", "locator", "path")


@query_all("""SELECT l_orderkey AS doc, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS DOUBLE) AS minutes, round(sum(l_extendedprice), 2) AS x FROM lineitem GROUP BY 1""")
def tables_to_rows(spark, sf):
    rows = k.tables_to_rows(_tables(spark, sf), "text", "doc")
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("t_minutes").alias("minutes"), F.round(F.sum("x"), 2).alias("x"))
